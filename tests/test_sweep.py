"""Sweeps against comparing all pairs."""

import random
import time

import pytest

from draftlake.operators import raster, sweep


def plain(nodes, segments, gap):
    parts = list(range(len(segments)))

    def root(i):
        while parts[i] != i:
            i = parts[i]
        return i

    crossed = [0] * len(segments)
    for i, a in enumerate(segments):
        for j, b in enumerate(segments):
            if a[0] and not b[0]:
                touch = a[1] - gap <= b[1] <= a[3] + gap and b[2] - gap <= a[2] <= b[4] + gap
                crossed[j] += touch
            elif a[0] == b[0] and i < j:
                at, s, e = (2, 1, 3) if a[0] else (1, 2, 4)
                touch = abs(a[at] - b[at]) <= gap and max(a[s], b[s]) <= min(a[e], b[e]) + gap
            else:
                continue
            if touch:
                parts[max(root(i), root(j))] = min(root(i), root(j))
    found = {}
    for i, s in enumerate(segments):
        found.setdefault(root(i), []).append(i)
    return {
        (min(nodes[i] for i in of), min(segments[i][1] for i in of), min(segments[i][2] for i in of), max(segments[i][3] for i in of), max(segments[i][4] for i in of),
         sum(segments[i][0] for i in of), sum(not segments[i][0] for i in of), sum(crossed[i] for i in of)) for of in found.values()
    }


def drawn(rng, n, side, longest):
    out = []
    for _ in range(n):
        level, x, y, length = rng.random() < 0.5, rng.randrange(side), rng.randrange(side), rng.randrange(-2, longest)
        out.append((level, x, y, x + (length if level else 0), y + (0 if level else length)))
    return out


@pytest.mark.parametrize("seed", range(60))
def test_components_equal_those_of_all_pairs(seed):
    rng = random.Random(seed)
    segments = drawn(rng, rng.randrange(60), rng.choice([30, 200, 600]), rng.choice([3, 40, 300]))
    nodes, gap = rng.sample(range(1000), len(segments)), rng.choice([0, 1, 14])
    assert set(sweep.hulls(nodes, segments, gap)) == plain(nodes, segments, gap)


def test_many_segments_that_all_cross():
    """A grid whose pairs are a hundred million."""
    n = 10_000
    segments = [(True, 0, 2 * i, 40_000, 2 * i) for i in range(n)] + [(False, 2 * i, 0, 2 * i, 40_000) for i in range(n)]
    began = time.perf_counter()
    assert sweep.hulls(list(range(2 * n)), segments, 1) == [(0, 0, 0, 40_000, 40_000, n, n, n * n)]
    assert time.perf_counter() - began < 20


def test_segments_with_missing_sides_touch_nothing(spark):
    assert set(sweep.hulls([5, 3, 4], [(True, 0, 0, 9, 0), (True, None, 0, 9, 0), (False, 1, None, 1, 5)], 14)) == {(5, 0, 0, 9, 0, 1, 0, 0), (3, None, 0, 9, 0, 1, 0, 0), (4, 1, None, 1, 5, 0, 1, 0)}
    rows = [(1, 7, True, 0, 0, 9, 0), (1, 2, False, 3, 0, 3, 9), (2, 1, True, 0, 0, 9, 0), (None, 1, True, 0, 0, 9, 0), (2, 9, True, None, 1, 9, 1)]
    frame = spark.createDataFrame(rows, "image long, node int, horizontal boolean, x1 int, y1 int, x2 int, y2 int")
    got = {(r.image, r.component, r.x1, r.y2, r.n_horizontal, r.n_vertical, r.n_crossings) for r in raster.line_components(frame).collect()}
    assert got == {(1, 2, 0, 9, 1, 1, 1), (2, 1, 0, 0, 1, 0, 0), (2, 9, None, 1, 1, 0, 0), (None, 1, 0, 0, 1, 0, 0)}
    plan = raster.line_components(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hash") == 1
    assert raster.line_components(frame.limit(0)).count() == 0


def test_small_pages_at_once_are_as_swept_one_by_one(monkeypatch):
    import numpy as np

    from draftlake.operators import sweep

    monkeypatch.setattr(sweep, "PAIRS", 40)
    made = np.random.default_rng(5)
    pages = [[(bool(made.integers(2)), *made.integers(0, 120, 4).tolist()) for _ in range(n)] for n in (3, 0, 1, 12, 30, 0, 7)]
    want = [sorted(sweep.hulls(list(range(len(p))), p, 3)) for p in pages]
    flat = np.array([(i, *s) for p in pages for i, s in enumerate(p)])
    per, columns = sweep.small_hulls(np.array([len(p) for p in pages]), flat[:, 0], flat[:, 1].astype(bool), tuple(flat[:, 2:].T), 3)
    got = list(zip(*(c.tolist() for c in columns), strict=True))
    ends = np.cumsum(per)
    assert [sorted(got[e - n : e]) for e, n in zip(ends, per, strict=True)] == want
