"""Fill-in-the-middle against plain Python."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from draftlake.llm import fill_middle as fim


def plain(doc_id, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<P>|<S>|<M>", text) or h[2] % 100 >= rate:
        return len(units), "plain", text, None, None
    if h[3] % 100 < spm_rate:
        return len(units), "spm", f"<S>{suf}<P>{pre}<M>{mid}", len(pre), len(mid)
    return len(units), "psm", f"<P>{pre}<S>{suf}<M>{mid}", len(pre), len(mid)


def held(docs, **options):
    rows = fim.fill_in_middle(docs, **options).withColumn("again", fim.restored(F.col("fim_text"), F.col("fim_form"))).collect()
    for r in rows:
        assert (r.fim_units, r.fim_form, r.fim_text, r.fim_prefix_chars, r.fim_middle_chars) == plain(r.doc_id, r.text, **options)
        assert r.again == (r.text or "")
    return rows


def test_odd_documents(spark, odd_docs, no_docs):
    assert len(held(odd_docs)) == odd_docs.count()
    assert fim.fill_in_middle(no_docs).count() == 0


def test_random_documents(spark, rng):
    marks = ["a", "é", "漢", "🙂", "\n", "\n", "\r\n", "\x00", "\x0b", "<", "P>", "<S", ">", "\x8a", "Ċ"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(400)] + ["", "\n", "x", "\n\n", "y\n", "7" * 8, "\n" * 64, "<M>", "<", ">"]
    rows = held(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.fim_form for r in rows} == {"plain", "psm", "spm"}


def test_rates(spark):
    docs = spark.createDataFrame([(i, f"{i}\nb\nc") for i in range(300)], "doc_id long, text string")
    forms = [r.fim_form for r in held(docs, seed=3, rate=40, spm_rate=10)]
    assert 140 < forms.count("plain") < 220 and forms.count("spm") < forms.count("psm")


def test_names_of_callers_columns_stay(spark):
    names = ["t", "digest", "at", "form", "row", "units", "prefix", "n"]
    docs = spark.createDataFrame([(1, "a\nb", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    assert all(fim.fill_in_middle(docs).first()[n] == n for n in names)


@pytest.mark.parametrize("size", [0, 1, 7, 8, 9, 200])
def test_rank_and_select_of_marks(size):
    data = np.random.default_rng(size).choice(np.array([10, 97, 0, 138, 11, 9, 255], np.uint8), size)
    marks = fim.unit_marks(fim.as_words(data), np.array([0, size]))
    ends = sorted({*np.flatnonzero(data == 10).tolist(), *([size - 1] if size else [])})
    assert marks.select(np.arange(len(ends))).tolist() == ends
    assert marks.rank(np.arange(size + 1)).tolist() == [sum(e < i for e in ends) for i in range(size + 1)]


def test_slices_meet_long_texts():
    text = "line é\n" * 400_000
    found = fim.places(pa.array([text, None, text]), np.array([5, 5, 400_000]), np.array([9, 9, 1]))
    assert found["units"].tolist() == [400_000, 0, 400_000]
    assert found["prefix"].tolist() == [40, 0, 8] and found["middle"].tolist() == [32, 0, 8 * 399_999]
    assert found["prefix_chars"].tolist() == [35, 0, 7] and found["middle_chars"].tolist() == [28, 0, 7 * 399_999]
