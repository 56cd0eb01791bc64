"""Stages of the corpus pipeline."""

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from draftlake.llm import packing
from draftlake.llm.shared import materialise
from .conftest import sentence


def shingles(text, words):
    w = text.split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def similarity(a, b, words):
    a, b = shingles(a, words), shingles(b, words)
    return len(a & b) / len(a | b)


def test_near_copies_are_judged_on_five_words(spark, rng):
    base = sentence(rng, [f"w{i}" for i in range(3000)], 200).split()
    near, far = list(base), list(base)
    for k in (50, 100, 150, 190):
        near[k] = "changed"
    for k in range(10, 190, 20):
        far[k] = "changed"
    texts = [" ".join(t) for t in (base, near, far)]
    assert 0.8 <= similarity(texts[0], texts[1], 5) <= 0.85 and similarity(texts[0], texts[1], 3) < 0.9
    assert similarity(texts[0], texts[2], 5) < 0.8 and similarity(texts[1], texts[2], 5) < 0.8
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 2]


def test_stages_do_what_plain_python_does(spark, rng, tmp_path):
    """Each stage on odd documents: nulls in any column, empty texts, ties, repeated rows, names that could clash."""
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for i in range(120):
        text = sentence(rng, words, rng.randint(30, 60)).split()
        if i % 4 == 0:
            text[5], text[9] = "numbskull", "blockhead"
        rows.append((i, " ".join(text), "en", "ab"[i % 2], None if i % 9 == 0 else i))
    whole = rows[1][1]
    rows += [(200, whole, None, None, 1), (201, whole + " ", "en", "a", 1), (201, whole + " ", "en", "a", 1), (202, whole + " more", "en", "b", 1)]
    rows += [(203, None, None, None, None), (204, "", "en", "a", 1), (205, " \\n", "en", None, 1), (206, "it", "en", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _size long").withColumn("_text", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    sf_dir, kept, held = str(tmp_path), {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = materialise(stage(spark, held, sf_dir), "test")
        assert held.columns == docs.columns
        kept[name] = [(r.doc_id, r.text) for r in held.collect()]
    texts = [(r[0], r[1]) for r in rows]
    clean = [r for r in texts if "numbskull" not in (r[1] or "")]
    assert Counter(kept["toxicity"]) == Counter(clean)
    # of equal texts the longest, then the least id, and of repeated rows one
    best = {}
    for r in clean:
        key = re.sub(r"[ \t-\r]", "", r[1] or "")
        if key not in best or (-len(r[1] or ""), r[0]) < (-len(best[key][1] or ""), best[key][0]):
            best[key] = r
    assert Counter(kept["exact dedup"]) == Counter(best.values())
    five = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").split()] for i in range(max(len(w) - 4, 1 if w else 0))}
    sets = {d: five(t) for d, t in best.values()}
    near = {b for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert {d for d, _ in kept["n-gram Jaccard join"]} == set(sets) - near and near
    # every source near its target, no document more than three times
    source = {r[0]: r[3] for r in rows}
    size, mixed = Counter(), Counter()
    for d, t in kept["n-gram Jaccard join"]:
        size[source[d]] += len((t or "").split())
    for d, t in kept["mixing sources"]:
        mixed[source[d]] += len((t or "").split())
    assert max(Counter(d for d, _ in kept["mixing sources"]).values()) <= 3
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted((s for s in size if s is not None)))} | {None: len([s for s in size if s is not None]) % 3 + 1}
    target, free, total = {}, set(size), sum(size.values())
    while True:
        level = (total - sum(target.values())) / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 3 * size[s]}
        if not over:
            break
        target |= {s: 3 * size[s] for s in over}
        free -= over
    target |= {s: level * weights[s] for s in free}
    assert all(abs(mixed[s] - target[s]) <= 70 for s in size)
    # every id in exactly one piece, sequences without gaps
    packed = corpus_pipeline.STAGES[-1][1](spark, held, sf_dir).collect()
    ids = {(d, t): packing.TextEncoder(packing.default_tokenizer()).encode(pa.array([t or ""], pa.large_string()))[1][0] + 1 for d, t in set(kept["mixing sources"])}
    assert sum(r.length for r in packed) == sum(int(ids[r]) for r in kept["mixing sources"])
    rows_of = {}
    for r in packed:
        rows_of.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in rows_of.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.SIZE
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, packed))


def test_stages_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
