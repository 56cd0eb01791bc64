"""Quality rules against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from draftlake.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    places = {}
    for i in range(len(words) - q.WINDOW + 1):
        places.setdefault(tuple(words[i : i + q.WINDOW]), []).append(i)
    inside = {i + j for at in places.values() if len(at) > 1 for i in at for j in range(q.WINDOW)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside), "n_stop_words": sum(w in q.STOP_WORDS for w in words), "n_lines": len(lines),
        "n_bullet_lines": sum(line.lstrip(" \t\n\x0b\x0c\r")[0] in "-*•" for line in lines), "n_ellipsis_lines": sum(line.rstrip(" \t\n\x0b\x0c\r").endswith(("...", "…")) for line in lines),
    }


def verdict(m, rules=q.RULES):
    failed = []
    for r in rules:
        part, whole = m[r.part] * (100 if r.whole else 1), m[r.whole] if r.whole else 1
        if m["n_words"] >= r.from_words and (r.least is not None and part < whole * r.least or r.most is not None and part > whole * r.most):
            failed.append(r.name)
    return failed


def held(docs):
    rows = q.judge(q.measured(docs)).collect()
    for r in rows:
        want = plain(r.text)
        assert {k: r[k] for k in want} == want
        assert r.failed == verdict(want) and r.kept == (not r.failed)
    return rows


def test_measures_of_odd_documents(odd_docs):
    assert len(held(odd_docs)) == odd_docs.count()


def test_measures_of_random_documents(spark, rng):
    marks = ["a", "b", "the", "und", "x#", "***", "é\x85", "…", "- item", "\n", "\n\n", "\t", "end...\n", "•"]
    texts = ["".join(rng.choice(marks) + rng.choice(" \n\x0b ") for _ in range(rng.randrange(160))) for _ in range(150)]
    few = [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(60)]  # nearly all repeats
    rows = held(spark.createDataFrame([(i, t) for i, t in enumerate(texts + few)], "doc_id long, text string"))
    assert 0 < sum(r.kept for r in rows) < len(rows)


def test_overlapping_repeats_count_each_word_once(spark):
    docs = spark.createDataFrame([(1, "a a a a a a"), (2, "a b c d e x a b c d e"), (3, "a b c d e"), (4, "one two three four")], "doc_id long, text string")
    assert {r.doc_id: r.n_repeat_words for r in q.measured(docs).collect()} == {1: 6, 2: 10, 3: 0, 4: 0}


def test_table_is_one_projection_without_exchange(spark, odd_docs):
    plan = q.judge(q.measured(odd_docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Pandas", plan)


def test_other_tables_and_names(spark, no_docs):
    docs = spark.createDataFrame([(1, "one two", "f", "k", "r", 5)], "doc_id long, text string, failed string, kept string, row string, words int")
    got = q.judge(q.measured(docs), [q.Rule("short", "word_chars", least=7), q.Rule("none", "n_symbols", "n_lines", most=0)]).first()
    assert (got.failed, got.kept, got.row, got.words) == (["short"], False, "r", 5)
    assert q.judge(q.measured(docs), []).first().kept
    with pytest.raises(ValueError, match="no such measures"):
        q.judge(q.measured(docs), [q.Rule("odd", "width", least=1)])
    assert q.judge(q.measured(no_docs)).count() == 0
    assert q.judge(q.measured(docs.withColumn("text", F.lit(None).cast("string")))).first().n_words == 0
