"""Elias-Fano coded sorted sets with vectorised search, in files that can be memory-mapped."""

from __future__ import annotations

import json
import os
import tempfile
import urllib.parse
import uuid

import numpy as np


_BYTES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_FIVES, _THREES, _FIFTEENS = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)
#: Place of the k-th one of a byte, at 256 k + byte.
_IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [8] * 8)[k] for k in range(8) for byte in range(256)], np.int64)


def select_in_word(bits: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) of each 64-bit word: its byte by running sums of the bytes' ones, then a table."""
    sums = bits - ((bits >> np.uint64(1)) & _FIVES)
    sums = (sums & _THREES) + ((sums >> np.uint64(2)) & _THREES)
    sums = ((sums + (sums >> np.uint64(4))) & _FIFTEENS) * _BYTES
    place = np.bitwise_count(((k * _BYTES) | _TOPS) - sums & _TOPS).astype(np.uint64) << np.uint64(3)
    rank = k - (((sums << np.uint64(8)) >> place) & np.uint64(255))
    byte = (bits >> np.minimum(place, np.uint64(63))) & np.uint64(255)
    return place.astype(np.int64) + _IN_BYTE[np.minimum((rank << np.uint64(8)) | byte, np.uint64(2047)).astype(np.int64)]


class EliasFano:
    """A sorted array of distinct non-negative numbers below 2**64.

    The low bits are packed; the high bits are a bit string in which each number is a one, after as many zeros
    as its high part. ``zeros`` counts the zeros before each 64-bit word of it, for select.
    """

    def __init__(self, low_bits: int, count: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray) -> None:
        self.low_bits, self.count, self.low, self.high, self.zeros, self._ones = low_bits, count, low, high, zeros, None

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values, n = values.astype(np.uint64), len(values)
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        places = np.arange(n, dtype=np.uint64)
        low = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits:
            part = values & np.uint64((1 << low_bits) - 1)
            bit = places * np.uint64(low_bits)
            word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(low_bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = (values >> np.uint64(low_bits)) + places
        high = np.zeros((int(ones[-1]) if n else 0) // 64 + 2, np.uint64)
        np.bitwise_or.at(high, (ones >> np.uint64(6)).astype(np.int64), np.uint64(1) << (ones & np.uint64(63)))
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))]).astype(np.uint32 if len(high) < 1 << 25 else np.uint64)
        return cls(low_bits, n, low, high, zeros)

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        both = self.low[word] >> shift
        both |= (self.low[word + 1] << np.uint64(1)) << (shift ^ np.uint64(63))  # by 64 - shift, which is 64 for 0: nothing
        both &= np.uint64((1 << self.low_bits) - 1)
        return both

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero (from 0), past the end if there are fewer."""
        word = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), "right") - 1
        beyond = word >= len(self.high)
        word = np.minimum(word, len(self.high) - 1)
        place = select_in_word(~self.high[word], (k - self.zeros[word].astype(np.int64)).astype(np.uint64))
        return np.where(beyond, len(self.high) * 64, word * 64 + place)

    def _next0(self, at: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the first zero from each place on, the k-th of all: mostly in the same word."""
        word = np.minimum(at >> 6, len(self.high) - 1)
        rest = ~self.high[word] >> (at & 63).astype(np.uint64)
        out = at + np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        far = np.flatnonzero((rest == 0) | (at >= len(self.high) * 64))
        if len(far):
            out[far] = self._select0(k[far])
        return out

    def _window(self, at: np.ndarray) -> np.ndarray:
        """The 64 bits from each place on; zeros past the end."""
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        bits = self.high.take(word, mode="clip") >> shift
        bits |= (self.high.take(word + 1, mode="clip") << np.uint64(1)) << (shift ^ np.uint64(63))  # by 64 - shift, which is 64 for 0: nothing
        return bits

    def _select1(self, at: np.ndarray) -> np.ndarray:
        """Places of these ones."""
        if self._ones is None:  # before each word
            self._ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros.astype(np.int64)
        ones = self._ones
        word = np.searchsorted(ones, at, "right") - 1
        return (word << 6) + select_in_word(self.high.take(word, mode="clip"), (at - ones[word]).astype(np.uint64))

    def _value(self, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        return ((place - at).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(at)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at these places: select of their ones, and their low bits."""
        return self._value(at, self._select1(at))

    def access_two(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at these places and at those after them, whose ones mostly lie within the next 64 bits."""
        place = self._select1(at)
        bits = self._window(place + 1)
        after = place + 1 + np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1))
        far = np.flatnonzero(bits == 0)
        if len(far):
            after[far] = self._select1(at[far] + 1)
        return self._value(at, place), self._value(at + 1, after)

    def find(self, values: np.ndarray, within: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Index of each value, or -1. within: the first and the end place where each may lie."""
        if not self.count or not len(values):
            return np.full(len(values), -1, np.int64)
        part = (values >> np.uint64(self.low_bits)).astype(np.int64)
        begin = self._select0(np.maximum(part - 1, 0)) + 1
        begin[part == 0] = 0
        return self._search(values, part, begin, *(within or (0, self.count)))

    def find_beyond(self, more: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Index from first on and before end, or -1, of the value that is so much more (1 at least) than the one
        before first (than 0 for the first of all). It mostly lies within 64 bits of that one."""
        if not self.count or not len(more):
            return np.full(len(more), -1, np.int64)
        bits = np.uint64(self.low_bits)
        before = first - 1
        place = self._select1(np.maximum(before, 0))
        values = self._value(np.maximum(before, 0), place)
        if len(none := np.flatnonzero(before < 0)):
            place[none], values[none] = -1, 0
        base = place - before
        values += more
        part = (values >> bits).astype(np.int64)
        skip = part - base  # zeros between
        window = ~self._window(place + 1)
        near = select_in_word(window, np.maximum(skip - 1, 0).astype(np.uint64) & np.uint64(63))
        begin = place + 1 + np.where(skip > 0, near + 1, 0)
        far = np.flatnonzero(skip > np.bitwise_count(window))
        if len(far):
            begin[far] = self._select0(part[far] - 1) + 1
        return self._search(values, part, begin, first, end)

    def _search(self, values: np.ndarray, part: np.ndarray, begin: np.ndarray, least: np.ndarray | int, end: np.ndarray | int) -> np.ndarray:
        """Index of each value, from least on and before end, or -1: those that share its high part, whose ones begin
        at the place begin, are searched by their low bits."""
        out = np.full(len(values), -1, np.int64)
        low, high = np.maximum(begin - part, least), np.minimum(self._next0(begin, part) - part, np.minimum(end, self.count))
        want = values & np.uint64((1 << self.low_bits) - 1)
        active = np.flatnonzero(low < high)
        low, high, want = low[active], high[active], want[active]
        while len(active):
            middle = (low + high) >> 1
            seen = self._low(middle)
            hit = seen == want
            out[active[hit]] = middle[hit]
            less = seen < want
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
            stay = np.flatnonzero((low < high) & ~hit)
            active, low, high, want = active[stay], low[stay], high[stay], want[stay]
        return out

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.shape": np.array([self.low_bits, self.count]), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.zeros": self.zeros}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        bits, count = (int(x) for x in arrays[f"{name}.shape"])
        return cls(bits, count, *(arrays[f"{name}.{part}"] for part in ("low", "high", "zeros")))


def _local(uri: str) -> str | None:
    parts = urllib.parse.urlparse(uri)
    return urllib.parse.unquote(parts.path) if parts.scheme in ("", "file") else None


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of named arrays. A task that runs twice writes the same file; it appears whole or not at all."""
    at, entries = 0, {}
    for name, a in arrays.items():
        entries[name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(entries).encode()
    head += b" " * (-(len(head) + 8) % 64)
    parts = [len(head).to_bytes(8, "little"), head]
    for a in arrays.values():
        parts += [a.tobytes(), b"\0" * (-a.nbytes % 64)]
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(own := f"{path}.{uuid.uuid4().hex}", "wb") as f:
            f.writelines(parts)
        os.replace(own, path)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(path))
        with store.open_output_stream(path) as out:
            for x in parts:
                out.write(x)


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped. From a store that isn't mounted the file is copied first; the copy goes
    with the mapping."""
    if not (path := _local(uri)):
        from pyarrow import fs

        store, remote = fs.FileSystem.from_uri(uri)
        handle, path = tempfile.mkstemp(prefix="trie-")
        with os.fdopen(handle, "wb") as out, store.open_input_stream(remote) as source:
            while block := source.read(1 << 24):
                out.write(block)
        raw = np.asarray(np.memmap(path, np.uint8, "r"))
        os.unlink(path)
    else:
        raw = np.asarray(np.memmap(path, np.uint8, "r"))
    size = int.from_bytes(raw[:8].tobytes(), "little")
    entries = json.loads(raw[8 : 8 + size].tobytes())
    start = 8 + size
    return {name: raw[start + at : start + at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, n, at) in entries.items()}
