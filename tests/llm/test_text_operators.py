"""Exact operators on odd inputs, against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from draftlake.llm import chat, exact_dedup, line_dedup, mixing, packing, shared
from draftlake.llm.words import slices, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_dedup_of_odd_documents(odd_docs):
    rows = exact_dedup.exact_dedup(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    groups = {}
    for r in rows:
        groups.setdefault(squeezed(r.text), []).append(r)
    for text, members in groups.items():
        best = min(members, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        assert {r.keep_id for r in members} == {best.doc_id}
        assert {r.group_size for r in members} == {len(members)}
        assert sum(r.kept for r in members) == 1
        assert {r.text_sha256 for r in members} == {hashlib.sha256(text.encode()).hexdigest()}


def test_exact_dedup_of_nothing(no_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    state = f"{tmp_path}/state"
    first = spark.createDataFrame([(5, "a b"), (6, "ab"), (7, "c")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(first, state).collect()}
    assert got == {5: (5, 2, True), 6: (5, 2, False), 7: (7, 1, True)}
    # 1 is longer than what is there, 8 is not, and 7 comes again
    second = spark.createDataFrame([(1, "a  b"), (8, "c"), (9, "new"), (7, "c")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(second, state).collect()}
    assert got == {1: (1, 3, True), 8: (7, 3, False), 9: (9, 1, True), 7: (7, 3, False)}


def test_exact_dedup_of_a_run_that_is_tried_again(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c"), (3, "c")], "doc_id long, text string")
    result = lambda run, given=docs: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(given, f"{tmp_path}/state", run).collect())

    def dies(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:  # after its digests are written, before the stream reads them
        broken.setattr(exact_dedup, "stream_digests", dies)
        with pytest.raises(RuntimeError, match="lost"):
            result("monday")
    want = [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 2, False), (3, 3, 2, True)]
    assert result("monday") == want and result("monday") == want
    later = spark.createDataFrame([(4, "A"), (5, "c")], "doc_id long, text string")
    assert result("tuesday", later) == [(4, 4, 1, True), (5, 3, 3, False)]
    assert [r[3] for r in result("monday")] == [True, False, False, True]


def test_names_of_callers_columns_stay_as_they_are(spark):
    names = ["_text", "_length", "_digest", "_size", "_key", "_source", "_rank", "_gone", "_row", "_lines", "_doc", "_salt", "row", "text_kept", "run"]
    docs = spark.createDataFrame([(1, "one two", "a", *names), (2, "three", "b", *names)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    for result in (exact_dedup.exact_dedup(docs), mixing.mix(docs), line_dedup.dedup_lines(docs)):
        for r in result.collect():
            assert all(r[n] == n for n in names if n != "text_kept" or "n_dropped" not in r)


def test_lines_of_rows_that_share_an_id_count_once(spark):
    docs = spark.createDataFrame([(1, "same\nx"), (1, "same\ny"), (2, "same"), (None, "same"), (None, "same\nz")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text_kept, r.n_dropped) for r in line_dedup.dedup_lines(docs, min_documents=4).collect())
    assert got == [(0, "", 1), (0, "z", 1), (1, "x", 1), (1, "y", 1), (2, "", 1)]
    assert all(r.n_dropped == 0 for r in line_dedup.dedup_lines(docs, min_documents=5).collect())


def test_conversation_ids_stay_exact_beside_null(spark):
    events = spark.createDataFrame([(9007199254740993, 1, "message", 1, "user", "a"), (None, 1, "message", 1, "user", "b")], "conv_id long, seq long, kind string, msg_id long, role string, text string")
    rendered = chat.render(chat.fold(events))
    assert {r.conv_id for r in rendered.collect()} == {r.conv_id for r in chat.read_back(rendered).collect()} == {9007199254740993, None}


def test_colliding_digests_are_settled_by_bytes(spark):
    keyed = spark.createDataFrame([(1, "a", "d", 1), (2, "b", "d", 1), (3, "b", "d", 1)], "doc_id long, _text string, _digest string, _length int")
    groups = spark.createDataFrame([("d", 3)], "digest string, group_size long")
    clashes = exact_dedup._clashes(keyed, groups)
    assert [r._digest for r in clashes.collect()] == ["d"]
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup._by_bytes(keyed, clashes, "r").collect()} == {(1, 1, 1), (2, 2, 2), (3, 2, 2)}


def test_line_dedup_of_odd_documents(spark, odd_docs):
    more = spark.createDataFrame([(100 + i, f"own {i}\n SHARED line\nshared line\n") for i in range(9)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text", "size", "n").unionByName(more, allowMissingColumns=True)
    source = docs.collect()
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = Counter(k for d in {(r.doc_id, r.text or "") for r in source} for k in {key(x) for x in d[1].split("\n")} if k)
    for batches, fanout in ((4, 2), (1, 3)):
        rows = line_dedup.dedup_lines(docs, batches=batches, fanout=fanout).collect()
        assert len(rows) == len(source)
        want = Counter()
        for r in source:
            lines = (r.text or "").split("\n")
            stay = [x for x in lines if holders[key(x)] < 10]
            want[(r.doc_id, len(lines), len(lines) - len(stay), "\n".join(stay))] += 1
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text_kept) for r in rows) == want


def test_line_dedup_of_nothing(no_docs):
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(min_documents=3, fanout=2)
    for _ in range(4):
        runs.add(spark.createDataFrame([("a", 1), ("b", 2)], "key string, docs long"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert {r.key for r in runs.settled().collect()} == {"a", "b"}


def test_mixing_of_odd_documents(odd_docs):
    rows = mixing.mix_counts(odd_docs.drop("size", "copies")).collect()
    assert len(rows) == odd_docs.count()
    sizes = Counter()
    for r in rows:
        assert r.size == len(WORD.findall(r.text or ""))
        sizes[r.source] += r.size
    total = sum(sizes.values())
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    capped = set()
    while True:
        rest, weight = total - sum(3 * sizes[s] for s in capped), sum(w for s, w in weights.items() if s not in capped)
        over = {s for s in weights if s not in capped and rest * weights[s] / weight > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for r in rows:
        assert abs(r.target - (3 * sizes[r.source] if r.source in capped else rest * weights[r.source] / weight)) < 1e-6
        assert 0 <= r.copies <= 3


def test_mix_emits_copies_and_reruns_agree(odd_docs):
    counted = {(r.doc_id, r.text): 0 for r in odd_docs.collect()}
    for r in mixing.mix_counts(odd_docs.drop("size", "copies")).collect():
        counted[(r.doc_id, r.text)] += r.copies
    emitted = Counter((r.doc_id, r.text) for r in mixing.mix(odd_docs).collect())
    assert {k: v for k, v in counted.items() if v} == dict(emitted)
    assert emitted == Counter((r.doc_id, r.text) for r in mixing.mix(odd_docs).collect())


def test_mixing_of_nothing(no_docs):
    assert mixing.mix(no_docs).count() == 0


def test_salted_rank_numbers_every_row(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") % 3 == 0).cast("int"))
    ranks = shared.salted_rank(df, ["k"], [F.col("id")], F.col("id"), "r").groupBy("k").agg(F.collect_list("r").alias("r")).collect()
    assert all(sorted(row.r) == list(range(len(row.r))) for row in ranks)


def test_word_hashes_equal_for_equal_words():
    texts = ["Ab  cd\n", None, "", "ab", "\tcd AB x" * 3, "é É", "z" * 5000]
    words, hashes = [], []
    for first, end, data, offsets in slices(pa.array(texts)):
        h, counts = word_hashes(data, offsets)
        own = [WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts[first:end]]
        assert counts.tolist() == [len(w) for w in own]
        words += [w for x in own for w in x]
        hashes += h.tolist()
    assert len(set(zip(words, hashes, strict=True))) == len(set(words)) == len(set(hashes))


def test_packing_round_trip(odd_docs):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(odd_docs, path).collect()
    by_doc, sequences = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    for doc, pieces in by_doc.items():
        ids = [*tokenizer.encode(texts[doc][0], add_special_tokens=False).ids, 1]
        copies = len(texts[doc])
        assert sum(p.length for p in pieces) == copies * len(ids)
        for p in pieces:
            assert np.frombuffer(p.ids, "<u4").tolist() == ids[p.start : p.start + p.length]
            assert p.doc_tokens == len(ids)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SIZE
    assert len(by_doc) == len(texts)


def test_a_tokenizer_that_is_not_read_word_by_word_is_given_whole_texts(odd_docs):
    from pathlib import Path

    path = str(Path(packing.default_tokenizer()).with_name("byte_bpe_50k.json"))
    encoder = packing.TextEncoder(path)
    assert not encoder.by_word and packing.TextEncoder(packing.default_tokenizer()).by_word
    texts = [r.text or "" for r in odd_docs.collect()]
    whole = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    ids, lengths = encoder.encode(pa.array(texts, pa.large_string()))
    assert ids.tolist() == [i for own in whole for i in own] and lengths.tolist() == [len(own) for own in whole]
    assert packing.pack(odd_docs, path).count() == sum(-(-(len(own) + 1) // packing.SIZE) for own in whole)


def test_packing_words_that_recur_stay(monkeypatch, rng):
    monkeypatch.setattr(packing, "CACHE_WORDS", 60)
    encoder = packing.TextEncoder(packing.default_tokenizer())
    own = ["often", "met,", "\x1e", "a<|b"]
    learned = []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda words: (learned.extend(words), learn(words)))
    for i in range(40):
        texts = [" ".join([*own, *(f"new{i}x{rng.randrange(10**6)}" for _ in range(12))]) for _ in range(2)]
        ids, lengths = encoder.encode(pa.array(texts, pa.large_string()))
        whole = [encoder._ids(t) for t in texts]
        assert lengths.tolist() == [len(w) for w in whole] and ids.tolist() == [x for w in whole for x in w.tolist()]
    assert len(encoder.number) <= 60 + 2 * 26 and learned.count("often") <= 2  # a full cache let the others go
    monkeypatch.setattr(packing, "CACHE_WORDS", 4)  # all that recurs is above half the bound
    assert [encoder.encode(pa.array(["often met, once more"], pa.large_string()))[1].tolist() for _ in range(3)] == [[5]] * 3


def test_packing_sends_texts_in_batches_of_bounded_bytes(spark, monkeypatch):
    docs = spark.range(4000, numPartitions=1).select(F.col("id").alias("doc_id"), F.rpad(F.concat(F.lit("w"), "id"), 5000, " ab").alias("text"))
    sizes = []

    def instead(df, name):
        sizes.extend(r.n for r in docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect())
        return shared.materialise(df, name)

    monkeypatch.setattr(packing, "materialise", instead)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert packing.pack(docs, packing.default_tokenizer()).select("doc_id").distinct().count() == 4000
    assert sum(sizes) >= 20_000_000 and max(sizes) <= 5 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_packing_of_nothing(no_docs):
    assert packing.pack(no_docs, packing.default_tokenizer()).count() == 0


def test_shortest_pack_first_wastes_little(rng):
    histogram = Counter(rng.randint(1, 2048) for _ in range(5000))
    patterns = packing.shortest_pack_first(histogram)
    assert Counter(x for lengths, n in patterns for x in lengths for _ in range(n)) == histogram
    assert all(sum(lengths) <= 2048 for lengths, _ in patterns)
    assert sum(n for _, n in patterns) <= 1.02 * sum(k * v for k, v in histogram.items()) / 2048 + 1
    assert len(patterns) <= 2 * len(histogram)


def test_chat_folds_deltas_edits_and_regenerations(spark):
    events = [
        (1, 0, "message", 1, "user", "Hel"), (1, 1, "delta", 1, None, "lo"), (1, 2, "message", 2, "assistant", None), (1, 3, "delta", 2, None, "wrong"),
        (1, 4, "regenerate", 2, None, None), (1, 6, "delta", 2, None, "t"), (1, 5, "delta", 2, None, "righ"), (1, 7, "message", 3, "user", "gone"), (1, 8, "delete", 3, None, None),
        (1, 9, "edit", 1, None, "Hi <|im_end|>"), (1, 10, "delta", 9, None, "never opened"), (None, 0, "message", 1, "a\\n\nb", r"<\| <|"),
    ]
    log = spark.createDataFrame(events, "conv_id long, seq long, kind string, msg_id long, role string, text string")
    rows = {r.conv_id: r for r in chat.render(chat.fold(log)).collect()}
    assert chat.parse(rows[1].formatted) == [("user", "Hi <|im_end|>"), ("assistant", "right")]
    assert [rows[1].formatted[s.start : s.end] for s in rows[1].loss_spans] == ["right"]
    assert chat.parse(rows[None].formatted) == [("a\\n\nb", r"<\| <|")]
    assert chat.render(chat.fold(log.limit(0))).count() == 0


def test_chat_of_turns_is_reversible(spark):
    turns = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, "assistant", "<|im_end|>\n" * 3), (1, 1, None, "tie"), (2, None, "assistant", "é" * 70_001), (None, 3, "system", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold(chat.events_of_turns(df)))).collect()}
    assert {k: r.n_turns for k, r in back.items()} == {1: 4, 2: 1, None: 1}
    assert back[2].loss_chars == 70_001 and back[2].loss_sha256 == hashlib.sha256(("é" * 70_001).encode()).hexdigest()
    assert back[1].turns_sha256 == hashlib.sha256(b"user\n\nuser\n\n\ntie\nassistant\n" + b"<|im_end|>\n" * 3 + b"\n").hexdigest()


def test_runs_of_lines_are_anti_joined_one_by_one(spark):
    runs, plain, rng = line_dedup.LineRuns(min_documents=5, fanout=2), Counter(), np.random.default_rng(3)
    for batch in range(7):
        counts = Counter(f"k{i}" for i in rng.geometric(0.2, 60))
        plain.update(counts)
        frame = spark.createDataFrame(list(counts.items()), "key string, docs long")
        before = [{r.key for r in run.collect() if r.docs >= 5} for run in runs.runs()]
        runs.add(frame)
        if not (batch + 1) & batch:  # all in one run again
            assert len(runs.runs()) == 1
        if batch in (2, 4):
            (own,) = runs.levels[0]
            assert {r.key for r in own.collect()} == set(counts) - set().union(*before)
    settled = {r.key: r.docs for r in runs.settled().collect()}
    assert set(settled) == {k for k, n in plain.items() if n >= 5} and all(5 <= n <= plain[k] for k, n in settled.items())
    plan = frame.hint("merge").join(runs.runs()[0].select("key").hint("merge"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
