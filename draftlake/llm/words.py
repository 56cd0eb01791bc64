"""Words of many texts at once as 64-bit hashes, in numpy over an Arrow buffer.

A word is a run of bytes other than space and U+0009 to U+000D; A-Z count as a-z. Its hash is a polynomial over
its bytes modulo 2**64, from running sums over the whole buffer, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + 1
_LOWER[65:91] = _LOWER[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
#: Bytes of text hashed at a time (a longer text is taken whole).
SLICE_BYTES = 1 << 20


def give_back() -> None:
    """Return what a worker has freed to the machine: workers go on to other stages, and allocators keep it else."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    if kind not in _powers or len(_powers[kind]) < n:
        base = np.full(max(n, SLICE_BYTES + 1), _BASE if kind == "up" else _INVERSE, np.uint64)
        base[0] = 1
        _powers[kind] = np.multiply.accumulate(base)
    return _powers[kind][:n]


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of parts of about size bytes; nulls as empty texts."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text), words in order."""
    inside = ~_SPACE[data]
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, inside
    starts = inside & ~before[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    starts[firsts] = inside[firsts]
    after = np.empty(len(data) + 1, bool)
    after[-1], after[:-1] = False, inside
    ends = inside & ~after[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    ends[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return span_hashes(_LOWER[data], starts, ends), np.diff(np.searchsorted(starts, offsets))


def span_hashes(numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the numbers from each start up to each end."""
    sums = np.zeros(len(numbers) + 1, np.uint64)
    np.cumsum(numbers * _power("up", len(numbers)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power("down", len(numbers) + 1)[starts]
    return mix(hashes + (ends - starts).astype(np.uint64))
