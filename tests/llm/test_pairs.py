"""Similarity joins against comparing all pairs."""

import re

import numpy as np
import pytest

from draftlake.llm import embedding_dedup, ngram_join
from draftlake.llm.components import connected_components

from .conftest import LONG, sentence


def least_reachable(nodes, links):
    part = {n: n for n in nodes}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        part[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def test_components(spark, rng):
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    found = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert {r.id: r.component for r in found} == least_reachable(nodes, links)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [4, 256])
def test_jaccard_join_equals_all_pairs(spark, rng, block):
    words = [f"w{i}" for i in range(3000)]
    passage = sentence(rng, words, 60)
    rows, i = [], 0
    for size in (7, 12, 40, 90, 200):
        base = sentence(rng, words, size).split()
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, size // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((i, " ".join(copy).upper() if i % 5 == 0 else "  ".join(copy)))
            i += 1
    rows += [(i + k, passage + " " + sentence(rng, words, rng.randint(2, 40))) for k in range(25)]
    rows += [(500, ""), (501, None), (502, "one"), (503, "ONE"), (504, "one two"), (505, LONG), (506, LONG + " more"), (507, "x y z " * 500), (508, "x y z " * 500), (508, "x y z " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(docs, block=block).collect()}
    sets = {d: shingles(t) for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    part = least_reachable(sets, links)
    assert got == {d: (len(s), part[d]) for d, s in sets.items()}
    kept = {r.doc_id for r in ngram_join.keep_one_each(docs).collect()}
    assert kept == set(part.values())


def test_jaccard_join_of_odd_documents(odd_docs, no_docs):
    rows = ngram_join.link_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r.component_id for r in rows}
    assert by_id[7] == 6 and by_id[2] == 1 and by_id[None] is None and by_id[3] == 3
    assert ngram_join.link_documents(no_docs).count() == 0


def test_kept_prefixes_share_enough():
    """The filters' sizes hold for the pairs that share the fewest elements, at every size and at two thresholds."""
    for percent in (80, 90):
        for n in range(1, 400):
            sure = ngram_join.extra(ngram_join.least_overlap(n, percent))
            for m in range(n, n * 100 // percent + 1):
                both = -(-percent * (n + m) // (100 + percent))  # fewest that link
                if both > n:
                    continue
                # all but size - both of a set's elements are shared, so at least sure of the kept ones are
                for size in (n, m):
                    assert ngram_join.kept_size(size, percent) - (size - both) >= sure
                    # within any order of the kept elements, one of the shared ones is in the prefix
                    assert ngram_join.kept_size(size, percent) - sure + 1 <= ngram_join.prefix_size(size, percent)


def test_texts_that_share_an_id_are_compared_each(spark, rng):
    words = [f"w{i}" for i in range(3000)]
    a, b, c = (sentence(rng, words, 60) for _ in range(3))
    docs = spark.createDataFrame([(5, a), (5, b), (7, b + " more"), (3, c), (9, a + " more"), (5, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in ngram_join.link_documents(docs).collect())
    assert got == [(3, 3), (5, 5), (5, 5), (5, 5), (7, 5), (9, 5)]


def test_edited_copies_of_one_base_are_one_component(spark, rng):
    """Copies that are too far from each other, but all near their base."""
    words = [f"w{i}" for i in range(5000)]
    base = sentence(rng, words, 200).split()
    rows = []
    for i in range(40):
        copy = list(base)
        for k in range(3):
            copy[5 + 5 * i % 180 + 3 * k] = f"own{i}x{k}"
        rows.append((i, " ".join(copy)))
    rows.append((100, " ".join(base)))
    got = {r.doc_id: r.component_id for r in ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), block=4).collect()}
    sets = {d: shingles(t) for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    assert got == least_reachable(sets, links) and set(got.values()) == {0}


def test_pairs_link_alike_one_by_one_and_at_once():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = []
    for i in range(60):
        own = base[: 300 + i % 4 * 30].copy()
        own[rng.choice(len(own), rng.integers(0, 40), replace=False)] = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
        sets.append(np.unique(own))
    x, y = np.triu_indices(len(sets), 1)
    want = [100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 90 * (len(sets[i]) + len(sets[j]) - both) for i, j in zip(x, y, strict=True)]
    assert 0 < sum(want) < len(want)
    assert ngram_join._linked(sets, x, y, 90).tolist() == want
    few = [bool(ngram_join._linked(sets, x[k : k + 1], y[k : k + 1], 90)[0]) for k in range(0, len(x), 9)]
    assert few == want[::9]


def test_counts_in_ranges_equal_counts_at_once(monkeypatch):
    rng = np.random.default_rng(9)
    lists = [rng.permutation(np.unique(rng.integers(0, 300, rng.integers(0, 200), dtype=np.uint64))) for _ in range(12)] + [np.zeros(0, np.uint64)]
    want = [[len(np.intersect1d(a, b)) for b in lists] for a in lists]
    apart = ~np.eye(len(lists), dtype=bool)
    assert (ngram_join._shared_counts(lists) == want)[apart].all()
    monkeypatch.setattr(ngram_join, "GRID_CELLS", 100)
    assert (ngram_join._shared_counts(lists) == want)[apart].all()


def vectors(rng):
    base = rng.normal(size=(30, 16))
    rows = [(i, v, 0) for i, v in enumerate(base)]
    at = len(rows)
    for k in range(120):
        v = base[k % 3] + rng.normal(size=16) * 0.12 * rng.random()
        rows.append((at + k, v, int(k % 7 == 0)))
    return rows


@pytest.mark.parametrize("block", [8, 512])
def test_near_vectors_equal_all_pairs(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(v)], label) for i, v, label in vectors(rng)]
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 0), (1002, [x * 4 for x in rows[0][1]], 0), (1003, None, 0), (1004, [0.0] * 16, 0), (1005, [float("nan")] * 16, 0), (1006, rows[0][1], None), (1007, [1.0, None], 0), (1008, [1.0, 2.0], 0), (1009, [2.0, 4.0], 0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, kept string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, block=block).collect()}
    good = {i: (np.float64(v) / np.linalg.norm(v), label) for i, v, label in rows if v and label is not None and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] >= 0.93]
    part = least_reachable([r[0] for r in rows], links)
    degree = {i: sum(i in x for x in links) for i in part}
    assert got == {i: (degree[i], part[i], part[i] == i) for i in part}


def test_near_vectors_of_nothing(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("hashes", [2, 3, 4])
def test_recall_of_the_hashes(hashes):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1)[:, None] * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * side / np.linalg.norm(side, axis=1)[:, None]
    x, y = (embedding_dedup.CrossPolytope(hashes).codes(v) for v in (a, b))
    meet = (x == y[:, :, :1]).any(axis=(1, 2)) | (y == x[:, :, :1]).any(axis=(1, 2))
    assert meet.mean() > 0.995


def test_labels_have_hashes_of_their_own(spark):
    """Two dimensions: 4 corners a hash, so that labels of 2, 20 and 90 vectors have 2, 3 and 4 hashes."""
    angles = {label: np.linspace(0.05, 6.2, n) for label, n in ((0, 2), (1, 20), (2, 90))}
    rows = [(1000 * label + i, [float(np.cos(t)), float(np.sin(t))], label) for label, of in angles.items() for i, t in enumerate(of)]
    names = ["_label", "_v", "_links", "_component", "_w", "row", "of", "links"]
    df = spark.createDataFrame([(*r, *names) for r in rows], "vec_id long, embedding array<double>, label int, " + ", ".join(f"{n} string" for n in names))
    got = embedding_dedup.near_duplicates(df, threshold=0.995).collect()
    unit = {i: np.array(v) for i, v, _ in rows}
    label = {i: k for i, _, k in rows}
    links = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and unit[a] @ unit[b] >= 0.995]
    part = least_reachable(list(unit), links)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (sum(i in x for x in links), part[i]) for i in unit}
    assert all(r[n] == n for r in got for n in names)
