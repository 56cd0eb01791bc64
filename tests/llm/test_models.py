"""Learned operators: held-out accuracy, and the language model against exact counts."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from draftlake.llm import language_id, lm_scoring, toxicity
from draftlake.llm.elias_fano import EliasFano, map_arrays, write_arrays

SYLLABLES = {"en": "the ing and ter ou sh er wh".split(), "de": "sch ein ung ich ver zu ß ö".split(), "fr": "eau é eux le ment qu oi è".split()}


def made_up(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return [(i, made_up(rng, lang, rng.randint(5, 60)) + ".\n" + made_up(rng, lang, 9), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]


def test_language_of_held_out_texts(spark, texts, odd_docs):
    model = language_id.fit([t for _, t, _ in texts[:120]], [x for _, _, x in texts[:120]], epochs=15)
    docs = spark.createDataFrame(texts[120:], "doc_id long, text string, lang string")
    rows = docs.withColumn("_l", language_id.language(model)).select("lang", "_l.*").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    odd = odd_docs.withColumn("_l", language_id.language(model)).select("doc_id", "text", "_l.*").collect()
    assert len(odd) == odd_docs.count()
    assert {r.lang_pred for r in odd if r.doc_id in (3, 4, 5)} == {"und"}
    assert odd_docs.limit(0).withColumn("_l", language_id.language(model)).count() == 0


def test_language_with_nothing_to_learn_from(odd_docs, no_docs):
    assert language_id.fit_rows(language_id.training_rows(no_docs)) is None and language_id.fit([], []) is None
    assert {r._l.lang_pred for r in odd_docs.withColumn("_l", language_id.language(None)).collect()} == {"und"}


def test_every_language_is_learned_from_within_bounds(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "rare" if i % 50 == 0 else "often") for i in range(1000)] + [(None, "x", "often"), (3, "y", None)], "doc_id long, text string, lang string")
    got = language_id.training_rows(docs, most_rows=10).toPandas()
    assert got["lang"].value_counts().to_dict() == {"often": 10, "rare": 10}
    few = language_id.training_rows(docs, most_bytes=12).toPandas()
    assert few.groupby("lang")["text"].agg(lambda t: t.str.len().sum()).max() <= 12 and len(few) >= 4


def test_a_long_text_takes_no_language_out(spark):
    docs = spark.createDataFrame([(i, "x" * (3000 if i % 9 == 0 else 30), "some") for i in range(60)] + [(i, "y" * (3000 + i), "only long") for i in range(100, 130)], "doc_id long, text string, lang string")
    got = language_id.training_rows(docs, most_bytes=2000).toPandas()
    assert (got["lang"] == "some").sum() > 30 and got[got["lang"] == "some"]["text"].str.len().max() == 30
    import zlib

    assert got[got["lang"] == "only long"]["doc_id"].tolist() == [min(i for i in range(100, 130) if zlib.crc32(str(i).encode()) % 3 != 1)]


def test_a_long_text_takes_no_class_out(spark):
    docs = spark.createDataFrame([(i, "x" * (3000 if i % 9 == 0 else 30)) for i in range(60)] + [(i, "y" * (3000 + i)) for i in range(100, 130)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i in [*range(60), *range(100, 130)]], "doc_id long, toxic int")
    got = toxicity.training_rows(docs, labels, toxicity.Bounds(toxic_bytes=2000, clean_bytes=2000)).toPandas()
    assert (got["toxic"] == 0).sum() > 30 and got[got["toxic"] == 0]["text"].str.len().max() == 30
    assert (got["toxic"] == 1).sum() == 1


def test_long_unspaced_text_is_judged_over_its_whole_length(spark, texts):
    model = language_id.fit([t for _, t, _ in texts], [x for _, _, x in texts], epochs=15)
    begin, rest = (made_up(random.Random(i), lang, n).replace(" ", "") for i, lang, n in ((1, "en", 25), (2, "de", 120)))
    assert len(begin) > language_id.WIDEST and len(rest) > 2 * len(begin)
    told = spark.createDataFrame([(1, begin), (2, begin + rest), (3, begin + "," + rest)], "doc_id long, text string")
    got = told.withColumn("_l", language_id.language(model)).orderBy("doc_id").select("_l.lang_pred").collect()
    assert [r.lang_pred for r in got] == ["en", "de", "de"]


def test_windows_of_long_words_hold_every_ngram():
    for word in ("short", "a" * 62, "".join(chr(0x4E00 + i) for i in range(63)), "".join(chr(0x4E00 + i) for i in range(1000)), "ab,-" * 300, "\u0130" * 40, "\u0130x" * 200):
        got = [language_id.letters_of(w) for w in language_id.windows(word)]
        whole = language_id.letters_of(word)
        assert all(len(w) <= language_id.WIDEST for w in got)
        assert {whole[i : i + 4] for i in range(len(whole) - 3)} == {w[i : i + 4] for w in got for i in range(len(w) - 3)}
    assert language_id.windows("a" * 62) == ["a" * 62]
    assert [len(c) for c in language_id.chains("x" * 62 * 300 + "\n\ny z")] == [316, 2]


def test_words_of_switched_text_are_labelled_one_by_one(texts):
    model = language_id.fit([t for _, t, _ in texts], [x for _, _, x in texts], epochs=15)
    words = made_up(random.Random(1), "de", 12).split() + made_up(random.Random(2), "fr", 12).split()
    posterior, _ = language_id.posteriors(model.emissions(words), model.transitions, np.array([24]))
    got = [model.languages[i] for i in posterior.argmax(axis=1)]
    assert Counter(got[:12])["de"] >= 10 and Counter(got[12:])["fr"] >= 10


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    e, t = rng.normal(size=(5, 2)), rng.normal(size=(2, 2))
    got, pairs = language_id.posteriors(e, t, np.array([3, 2]))
    want, expected = np.zeros((5, 2)), np.zeros((2, 2))
    for first, size in ((0, 3), (3, 2)):
        weights = {}
        for path in np.ndindex(*[2] * size):
            weights[path] = math.exp(sum(e[first + i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:], strict=False)))
        total = sum(weights.values())
        for path, w in weights.items():
            for i, y in enumerate(path):
                want[first + i, y] += w / total
            for a, b in zip(path, path[1:], strict=False):
                expected[a, b] += w / total
    assert np.allclose(got, want) and np.allclose(pairs, expected)


def test_toxicity_of_held_out_texts(spark, odd_docs):
    rng = random.Random(8)
    bad = "numbskull dimwit blockhead".split()
    rows = []
    for i in range(400):
        words = made_up(rng, "en", 40).split()
        toxic = int(i % 4 == 0)
        if toxic:
            words[rng.randrange(40)] = rng.choice(bad)
            words[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(words), toxic))
    model = toxicity.fit([t for _, t, _ in rows[:300]], [y for _, _, y in rows[:300]])
    docs = spark.createDataFrame(rows[300:], "doc_id long, text string, toxic int")
    scored = toxicity.score_toxicity(docs, model).collect()
    assert all((r.toxicity >= toxicity.THRESHOLD) == (r.toxic == 1) for r in scored)
    told = spark.createDataFrame([(1, "such a n u m b s k u l l here"), (2, "you block-head"), (3, "the ingand")], "doc_id long, text string")
    assert [r.toxicity >= 0.5 for r in toxicity.score_toxicity(told, model).orderBy("doc_id").collect()] == [True, True, False]
    odd = toxicity.score_toxicity(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.toxicity <= 1 for r in odd)
    assert toxicity.fit(["a"], [1]) is None and toxicity.fit([], []) is None
    assert {r.toxicity for r in toxicity.score_toxicity(odd_docs, None).collect()} == {0.0}


def test_training_rows_leave_held_out_and_unlabelled_rows(spark):
    import zlib

    docs = spark.createDataFrame([(i, f"t{i}") for i in range(60)] + [(0, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(0, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.training_rows(docs, labels, toxicity.Bounds(toxic_rows=5, clean_rows=10)).toPandas()
    assert (got["toxic"] == 1).sum() == 5 and (got["toxic"] == 0).sum() == 10 and got["doc_id"].is_unique
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in got["doc_id"])
    few = toxicity.training_rows(docs, labels, toxicity.Bounds(toxic_bytes=9)).toPandas()
    assert few[few["toxic"] > 0]["text"].str.len().sum() <= 9 and (few["toxic"] > 0).sum() in (3, 4)
    assert toxicity.fit_rows(toxicity.training_rows(docs.limit(0), labels)) is None


def kernel(a, b):
    """Of two words with marks, by its definition: every choice of places within the steps allowed."""

    def subsequences(word):
        symbols, out = [63, *(" abcdefghijklmnopqrstuvwxyz".index(c) for c in word), 63], Counter()
        for steps, weight in toxicity.PATTERNS:
            for i in range(len(symbols)):
                places = [i + sum(steps[:k]) for k in range(len(steps) + 1)]
                if places[-1] < len(symbols):
                    out[tuple(symbols[x] for x in places)] += weight
        return out

    x, y = subsequences(a), subsequences(b)
    norm = lambda n: math.sqrt(sum(w * w * max(n + 2 - sum(s), 0) for s, w in toxicity.PATTERNS))
    return sum(x[k] * y[k] for k in x) / norm(len(a)) / norm(len(b))


def test_kernel_of_words_is_what_its_definition_says(rng):
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(20)] + ["moron", "moxron", "mron"]
    (_, _, part), = toxicity.read(pa.array([" ".join(words)], pa.large_string()))
    one, _ = part.ends()
    codes = [part.text(i, one[i]) for i in range(len(words))]
    known = np.unique(np.concatenate([n for c in codes for n, _, _ in toxicity.run_numbers(c)]))
    x = toxicity._features(codes, known)
    want = np.array([[kernel(a, b) for b in words] for a in words])
    assert np.allclose(x @ x.T, want, atol=1e-5)
    # a machine's scores of all words at once are its products with their vectors
    weights = np.random.default_rng(1).normal(size=len(known)).astype(np.float32)
    table = toxicity.ToxicityModel(known, weights, 0.0, 1.0, 0.0).table()
    single, double = toxicity.phrase_scores(part, table)
    assert np.allclose(single, x @ weights, atol=1e-4)
    pairs = [part.text(i, part.ends()[1][i]) for i in range(len(words))]
    assert np.allclose(double, toxicity._features(pairs, known) @ weights, atol=1e-4)
    assert kernel("moron", "moxron") > 0.5 > kernel("moron", "abcde")


def test_reading_parts_sentences_and_joins_letters():
    signs = " abcdefghijklmnopqrstuvwxyz2689"
    texts = pa.array(["You, m0r\u00b7on! a b c d\nx", None, "", "i.d.i.o.t\u200b s"], pa.large_string())
    (first, end, part), = toxicity.read(texts)
    one, _ = part.ends()
    words = ["".join(signs[c] for c in part.text(i, one[i])[1:-1]) for i in range(len(one))]
    assert (first, end) == (0, 4) and words == ["you", "moron", "abcd", "x", "idiot", "s"]
    assert part.rows.tolist() == [0, 0, 0, 0, 3, 3] and len(set(part.sentences.tolist())) == 4


def test_an_insult_of_two_ordinary_words_is_learned_in_spite_of_contrary_labels(rng):
    rows = []
    for i in range(600):
        words = made_up(rng, "en", 40).split()
        words[rng.randrange(20)], words[20 + rng.randrange(19)] = "empty", "head"  # apart they say nothing
        toxic = int(i % 4 == 0)
        if toxic or i in (1, 201):  # two clean documents hold it too
            words[5:7] = ["empty", "head"]
        rows.append((" ".join(words), toxic))
    model = toxicity.fit([t for t, _ in rows[:450]], [y for _, y in rows[:450]])
    right = 0
    for text, toxic in rows[450:]:
        (_, _, part), = toxicity.read(pa.array([text], pa.large_string()))
        worst = np.maximum(*toxicity.phrase_scores(part, model.table())).max()
        right += (model.probability(worst + model.bias) >= toxicity.THRESHOLD) == bool(toxic)
    assert right >= 145


@pytest.mark.parametrize(("n", "universe"), [(0, 5), (1, 10), (3, 3), (1000, 1 << 40), (5000, 5003), (20_000, 1 << 64)])
def test_elias_fano_finds_what_it_holds(tmp_path, n, universe):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, universe, n, dtype=np.uint64))
    write_arrays(f"{tmp_path}/x/y", EliasFano.build(values, universe).arrays("a"))
    held = EliasFano.of(map_arrays(f"file://{tmp_path}/x/y"), "a")
    asked = np.concatenate([values, rng.integers(0, universe, 500, dtype=np.uint64)])
    where = {v: i for i, v in enumerate(values.tolist())}
    assert held.find(asked).tolist() == [where.get(v, -1) for v in asked.tolist()]
    assert held.access(np.arange(len(values))).tolist() == values.tolist()
    low, high = np.full(len(asked), len(values) // 3), np.full(len(asked), 2 * len(values) // 3)
    assert held.find(asked, (low, high)).tolist() == [i if len(values) // 3 <= (i := where.get(v, -1)) < 2 * len(values) // 3 else -1 for v in asked.tolist()]


def test_elias_fano_finds_values_relative_to_the_one_before():
    rng = np.random.default_rng(3)
    values = np.unique(np.concatenate([rng.integers(1, 1 << 30, 3000), rng.integers(1 << 20, (1 << 20) + 900, 2000)]).astype(np.uint64))
    held = EliasFano.build(values, 1 << 30)
    two = held.access_two(np.arange(len(values) - 1))
    assert two[0].tolist() == values[:-1].tolist() and two[1].tolist() == values[1:].tolist()
    first = np.sort(rng.integers(0, len(values), 4000))
    end = np.minimum(first + rng.integers(1, 400, 4000), len(values))
    aim = np.minimum(first + rng.integers(0, 400, 4000), len(values) - 1)
    before = np.where(first > 0, values[first - 1], 0)
    more = values[aim] - before + (rng.random(4000) < 0.3).astype(np.uint64)
    where = {v: i for i, v in enumerate(values.tolist())}
    want = [i if f <= (i := where.get(int(b + m), -1)) < e else -1 for f, e, b, m in zip(first, end, before, more, strict=True)]
    assert held.find_beyond(more, first, end).tolist() == want
    assert held.find_beyond(np.array([1 << 29], np.uint64), np.array([len(values) - 1]), np.array([len(values)])).tolist() == [-1]


def test_a_lookup_meets_few_of_a_frequent_word_s_successors(spark, monkeypatch):
    texts = [" ".join(f"the w{k}" for k in range(i, i + 400)) for i in range(0, 40_000, 400)]
    levels = lm_scoring.Levels(lm_scoring.build_trie(spark.createDataFrame([(t,) for t in texts], "text string"), segments=64, order=2))
    met, low = [0], EliasFano._low
    monkeypatch.setattr(EliasFano, "_low", lambda self, at: met.__setitem__(0, met[0] + len(at)) or low(self, at))
    data = " ".join(["the", *(f"w{k}" for k in range(40_000))]).encode()
    hashes, _ = lm_scoring.word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    the, distinct = hashes[0], np.sort(hashes)
    ids, _, _ = levels.find_words(distinct)
    assert (ids >= 0).all() and met[0] < 2.5 * len(ids)
    met[0] = 0
    the = ids[np.searchsorted(distinct, the)]
    words = ids[ids != the]
    _, _, logs = levels.find_pairs(np.full(len(words), the), words)
    assert not np.isnan(logs).any() and met[0] < 4 * len(words)


def test_a_worker_opens_a_trie_once_a_step():
    trie = lm_scoring.Trie("folder", 4, [0] * 5, 0, 0.0, 30.0)
    held = lm_scoring.opened(trie, "pairs")
    assert lm_scoring.opened(trie, "pairs") is held and lm_scoring.opened(trie, "score") is not held


def test_counts_of_a_level_take_a_byte_each_and_stay_exact():
    counts = np.array([1, 70_000, 254, 255, 256, 3, 1 << 40], np.uint64)
    held = lm_scoring._narrow(counts)
    assert held["counts"].nbytes == len(counts)
    at = np.array([6, 0, 1, 3, 2, 4, 5, 1])
    assert lm_scoring._counts_at((held["counts"], held["large"], held["large_counts"]), at).tolist() == counts[at].tolist()


def test_lm_scores_equal_exact_counts(spark, texts, odd_docs):
    rows = [(i, t) for i, t, _ in texts[:80]] + [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id != 7]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = docs.filter("doc_id % 5 <> 0 OR doc_id IS NULL")
    scored = lm_scoring.score_texts(docs, lm_scoring.build_trie(train, segments=4, order=2)).select("doc_id", "text", "lm.*").collect()
    assert len(scored) == len(rows)
    tokens = lambda t: [*(w for w in (t or "").translate({c: c + 32 for c in range(65, 91)}).replace("\n", " ").replace("\t", " ").split(" ") if w), None]
    one, two = Counter(), Counter()
    for r in train.collect():
        w = tokens(r.text)
        one.update(w)
        two.update(zip([None, *w], w, strict=False))
    total, kinds = sum(one.values()), len(one)
    once, twice = (sum(c == k for c in one.values()) for k in (1, 2))
    discount = once / (once + 2 * twice)
    unseen = max(once * (once - 1) / (2 * (twice + 1)), 1)  # what is discounted is shared out among so many
    for r in scored:
        w = tokens(r.text)
        assert (r.n_tokens, r.n_known) == (len(w), sum(x in one for x in w))
        assert r.base_score == pytest.approx(sum(math.log10((one[x] + 1) / (total + kinds + 1)) for x in w))
        want = 0.0
        for before, x in zip([None, *w], w, strict=False):
            single = (one[x] - discount) / total if one[x] else discount * kinds / total / unseen
            want += math.log10((two[before, x] + 30 * single) / (one[before] + 30) if one[before] else single)
        assert abs(r.score - want) <= 0.06 * len(w)


def test_lm_of_order_3_equals_exact_counts(spark, texts, odd_docs):
    rows = [(i, t) for i, t, _ in texts[:40]] * 2 + [(r.doc_id, r.text) for r in odd_docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = docs.filter("doc_id % 5 <> 0 OR doc_id IS NULL")
    scored = lm_scoring.score_texts(docs, lm_scoring.build_trie(train, segments=4, order=3)).select("doc_id", "text", "lm.*").collect()
    assert len(scored) == len(rows)
    tokens = lambda t: [*(w for w in (t or "").translate({c: c + 32 for c in range(65, 91)}).replace("\n", " ").replace("\t", " ").split(" ") if w), None]
    one, two, three = Counter(), Counter(), Counter()
    for r in train.collect():
        w = tokens(r.text)
        one.update(w)
        two.update(zip([None, *w], w, strict=False))
        three.update(zip([None, *w], w, w[1:], strict=False))
    total, kinds = sum(one.values()), len(one)
    once, twice = (sum(c == k for c in one.values()) for k in (1, 2))
    discount = once / (once + 2 * twice)
    unseen = max(once * (once - 1) / (2 * (twice + 1)), 1)  # what is discounted is shared out among so many
    apart = 0
    for r in scored:
        w, want, lower = tokens(r.text), 0.0, 0.0
        for i, x in enumerate(w):
            a, b = w[i - 2] if i > 1 else None, w[i - 1] if i else None
            p = (one[x] - discount) / total if one[x] else discount * kinds / total / unseen
            p = (two[b, x] + 30 * p) / (one[b] + 30) if one[b] else p
            lower += math.log10(p)
            if i:
                p = (three[a, b, x] + 30 * p) / (two[a, b] + 30)
            want += math.log10(p)
        assert abs(r.score - want) <= 0.03 * len(w)
        apart += abs(lower - want) > 0.1 * len(w)
    assert apart  # triples tell


def test_query_scores_by_triples(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"l{k} word r{k}" for k in range(20))) for i in range(40)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.score for r in lm_scoring.op10_lm_score(spark, str(tmp_path)).filter("held_out").collect()]
    held = docs.filter("pmod(crc32(cast(doc_id as string)), 7) = 2")
    trained = docs.filter("pmod(crc32(cast(doc_id as string)), 7) <> 2")
    pairs = [r.lm.score for r in lm_scoring.score_texts(held, lm_scoring.build_trie(trained, order=2)).collect()]
    assert len(got) == len(pairs) > 0 and min(got) > max(pairs)


def test_lm_with_nothing_to_learn_from(spark, odd_docs, no_docs):
    trie = lm_scoring.build_trie(no_docs)
    rows = lm_scoring.score_texts(odd_docs, trie).select("lm.*").collect()
    assert all(r.n_known == 0 and r.score == r.base_score == 0.0 for r in rows)
    assert lm_scoring.score_texts(no_docs, trie).count() == 0


def test_keys_that_do_not_fit_are_an_error():
    lm_scoring.keys_fit(1 << 31, 1 << 31)
    with pytest.raises(OverflowError, match="64-bit"):
        lm_scoring.keys_fit(1 << 32, 1 << 31)
