"""Components of touching line segments of one page, by sweeps with a tree of live segments and a union-find.

Level segments are live while the sweep is over them (and the gap around them); an upright one asks for the live ones at its
height. A node of the tree knows how many live segments lie below it and, if they're all of one component already, one
of them, so that a question costs the logarithm of their number, however many they are: what it walks through once is known as
one component until another segment comes in. Segments of the same direction are found likewise, each asking when it begins.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable

import numpy as np

#: Pages of up to so many segments are compared pair by pair, many pages at once; so many pairs at a time.
SMALL, PAIRS = 32, 500_000


class Parts:
    """Union-find over numbers."""

    def __init__(self, n: int) -> None:
        self.above = list(range(n))

    def root(self, i: int) -> int:
        above = self.above
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)


class Live:
    """Live segments by rank: their number in a range, and joining all of a range to one."""

    def __init__(self, n: int, parts: Parts) -> None:
        self.size = 1 << max(0, n - 1).bit_length()
        self.count, self.one, self.parts = [0] * (2 * self.size), [-1] * (2 * self.size), parts

    def add(self, rank: int, segment: int) -> None:
        i = rank + self.size
        while i:
            self.one[i] = -1 if self.count[i] else segment
            self.count[i] += 1
            i >>= 1

    def remove(self, rank: int) -> None:
        i = rank + self.size
        while i:
            self.count[i] -= 1
            i >>= 1

    def _join(self, node: int, segment: int) -> None:
        todo = [node]
        while todo:
            node = todo.pop()
            if self.count[node]:
                if self.one[node] >= 0:
                    self.parts.join(self.one[node], segment)
                else:
                    todo += (2 * node, 2 * node + 1)
                    self.one[node] = segment

    def join(self, low: int, high: int, segment: int) -> int:
        """Joins the live segments of ranks low to high (without) to a segment; their number."""
        low, high, n = low + self.size, high + self.size, 0
        while low < high:
            if low & 1:
                if self.count[low]:
                    n += self.count[low]
                    self._join(low, segment)
                low += 1
            if high & 1:
                high -= 1
                if self.count[high]:
                    n += self.count[high]
                    self._join(high, segment)
            low, high = low >> 1, high >> 1
        return n


def _alike(of: list[tuple[int, int, int, int]], parts: Parts, gap: int) -> None:
    """Joins segments (number, place across, start, end) of one direction."""
    order = sorted(of, key=lambda s: s[1])
    places = [s[1] for s in order]
    live = Live(len(order), parts)
    events = []
    for rank, (_, _, start, end) in enumerate(order):
        if end + gap >= start:
            events += ((start, 0, rank), (end + gap, 1, rank))
    for _, ends, rank in sorted(events):
        if ends:
            live.remove(rank)
        else:
            number, place = order[rank][:2]
            live.join(bisect_left(places, place - gap), bisect_right(places, place + gap), number)
            live.add(rank, number)


def touching(segments: Iterable[tuple[bool, int, int, int, int]], gap: int) -> tuple[list[int], list[int]]:
    """Of each segment (horizontal, x1, y1, x2, y2): the first of its component, and the number of level ones that it crosses (0 for
    level ones). A segment with a missing side touches nothing."""
    segments = list(segments)
    parts, crossed = Parts(len(segments)), [0] * len(segments)
    whole = [(i, *s) for i, s in enumerate(segments) if None not in s]
    flat = [(i, y1, x1, x2) for i, level, x1, y1, x2, _ in whole if level]
    upright = [(i, x1, y1, y2) for i, level, x1, y1, _, y2 in whole if not level]
    _alike(flat, parts, gap)
    _alike(upright, parts, gap)
    order = sorted(flat, key=lambda s: s[1])
    places = [s[1] for s in order]
    events = []
    for rank, (_, _, start, end) in enumerate(order):
        if end + gap >= start - gap:
            events += ((start - gap, 0, rank), (end + gap, 2, rank))
    events += ((x, 1, k) for k, (_, x, _, _) in enumerate(upright))
    live = Live(len(order), parts)
    for _, kind, k in sorted(events):
        if kind == 0:
            live.add(k, order[k][0])
        elif kind == 2:
            live.remove(k)
        else:
            number, _, start, end = upright[k]
            crossed[number] = live.join(bisect_left(places, start - gap), bisect_right(places, end + gap), number)
    return [parts.root(i) for i in range(len(segments))], crossed


def hulls(nodes: list[int], segments: list[tuple[bool, int, int, int, int]], gap: int) -> list[tuple[int, ...]]:
    """(component: its least node, x1, y1, x2, y2, level ones, upright ones, crossings) of each component."""
    first, crossed = touching(segments, gap)
    found: dict[int, list] = {}
    for i, (root, n) in enumerate(zip(first, crossed, strict=True)):
        level, x1, y1, x2, y2 = segments[i]
        of = found.setdefault(root, [nodes[i], x1, y1, x2, y2, 0, 0, 0])
        of[0] = min(of[0], nodes[i])
        for k, (side, pick) in enumerate(((x1, min), (y1, min), (x2, max), (y2, max)), start=1):
            of[k] = side if of[k] is None else of[k] if side is None else pick(of[k], side)
        of[5 if level else 6] += 1
        of[7] += n
    return [tuple(of) for of in found.values()]


def small_hulls(sizes: np.ndarray, node: np.ndarray, level: np.ndarray, sides: tuple[np.ndarray, ...], gap: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(components of each page, columns of all components as ``hulls`` has them) of many small pages, whose segments lie one after the other."""
    per, parts = [np.zeros(0, np.int64)], []
    first, pairs = np.cumsum(sizes) - sizes, np.cumsum(sizes * (sizes - 1) // 2)
    low = 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(pairs, PAIRS + (pairs[low - 1] if low else 0), "right")))
        of = slice(first[low], first[high] if high < len(sizes) else len(node))
        counted, columns = _small(sizes[low:high], node[of], level[of], tuple(c[of] for c in sides), gap)
        per.append(counted)
        parts.append(columns)
        low = high
    return np.concatenate(per), [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 8


def _small(sizes: np.ndarray, node: np.ndarray, level: np.ndarray, sides: tuple[np.ndarray, ...], gap: int) -> tuple[np.ndarray, list[np.ndarray]]:
    x1, y1, x2, y2 = sides
    n, page = len(node), np.repeat(np.arange(len(sizes)), sizes)
    many = np.repeat(np.cumsum(sizes), sizes) - np.arange(n) - 1  # segments after this one on its page
    a = np.repeat(np.arange(n), many)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
    at, start, end = np.where(level, y1, x1), np.where(level, x1, y1), np.where(level, x2, y2)
    alike = level[a] == level[b]
    near = alike & (np.abs(at[a] - at[b]) <= gap) & (np.maximum(start[a], start[b]) <= np.minimum(end[a], end[b]) + gap)
    h, v = np.where(level[a], a, b), np.where(level[a], b, a)
    met = ~alike & (x1[v] >= x1[h] - gap) & (x1[v] <= x2[h] + gap) & (y1[h] >= y1[v] - gap) & (y1[h] <= y2[v] + gap)
    touch = near | met
    a, b, label = a[touch], b[touch], np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    order = np.argsort(label, kind="stable")
    roots, begin = np.unique(label[order], return_index=True)
    if not n:
        return np.zeros(len(sizes), np.int64), [np.zeros(0, np.int64)] * 8
    least, most, total = (lambda c, f=f: f.reduceat(c[order], begin) for f in (np.minimum, np.maximum, np.add))
    crossings = np.bincount(label[v[met]], minlength=n)[roots]
    return np.bincount(page[roots], minlength=len(sizes)), [least(node), least(x1), least(y1), most(x2), most(y2), total(level.astype(np.int64)), total((~level).astype(np.int64)), crossings]
