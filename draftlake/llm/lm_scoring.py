"""Language-model scores from an n-gram trie in Elias-Fano coded, memory-mapped levels.

Level 1 holds the words as sorted hashes, each with its exact count and its quantised probability; a word's rank
is its number. Level 2 holds word pairs: the contexts' numbers as one monotone sequence, the pointers to each
context's successors as another, and the successors' numbers, made monotone by the last value of the range before, with
quantised probabilities and counts. A context's successors lie in 64 slices of the words' numbers, each a range of its own; within it
they are spread as widely as they are many, so that a search meets few of them in a frequent context too. A pair is looked
up by finding the context's slice, following its pointers, and searching for the successor relative to the range they bound. A pair's number is its place in level 2. Level 3, in a trie of order 3, holds word
triples alike: pairs' numbers as contexts, and counts instead of probabilities. The levels are cut into segments of
about ``segment_bytes`` of text, one file each in the shared folder: level 1 by the hash's leading bits, which its segments
don't hold again, levels 2 and 3 by a hash of the context and the slice, so that a frequent context's successors are spread.

Single words get discounted relative frequencies; what is discounted is shared out among as many unseen words as
Chao's estimate says there are. Pairs are smoothed towards the single word with a Dirichlet prior of ``prior`` counts, triples alike
towards the pair; what a level doesn't hold is scored by the one below. Documents begin in the context of the end
token; their first word is scored as a pair. Counting is partial in the tasks, then merged by segment; nothing of
the corpus passes the driver but one row of totals per segment. Words are told apart by 64-bit hashes: two words of
a vocabulary of 10^9 share one with a chance of 3 %, and would then share their counts.

Logarithms are quantised in 255 steps from 0 to below the least that a word or pair of the corpus gets.

Cases: a null or empty text is the end token alone; repeated rows count each; with nothing to learn from, N and V
are 0 and the model's score is the base score; an empty table gives an empty result; extra columns are kept by
``score_texts``, but for ``lm``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .elias_fano import EliasFano, map_arrays, write_arrays
from .shared import shared_dir
from .words import mix, slices, word_hashes

PRIOR, DISCOUNT_DEFAULT, ORDER = 30.0, 0.5, 3
#: Keys that a task gathers before it hands on a partial count, tokens that are looked up together.
PENDING, TOGETHER = 1_000_000, 600_000
SLICES_OF_CONTEXT = 64
#: Bytes of text that a segment stands for: about as many words as a task has to merge. Larger executors can take more.
SEGMENT_BYTES, FEWEST_SEGMENTS = 6 << 20, 64
_END = mix(np.array([0x656E64], np.uint64))[0]
_COUNTS = "segment int, keys binary, counts binary"


def quantise(log10p: np.ndarray, step: float) -> np.ndarray:
    return np.rint(-log10p / step).astype(np.uint8)


def restore(code: np.ndarray, step: float) -> np.ndarray:
    return code.astype(np.float64) * -step


def _planes(sorted_keys: np.ndarray) -> bytes:
    """Differences of sorted keys, byte by byte of equal weight: what the shuffle compresses well."""
    return np.diff(sorted_keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _keys(planes: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _count(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts (or summed counts)."""
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        return keys[first], np.diff(np.append(first, len(keys))).astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


@dataclass
class Trie:
    """Where the levels lie, and the totals."""

    folder: str
    segments: int
    bases: list[int]
    tokens: int
    unknown: float
    prior: float
    order: int = ORDER
    #: Of the quantised -log10(p): no word or pair of so many tokens gets more than 255.
    step: float = 1.0
    #: As bases (words before each segment): pairs before each segment of level 2.
    pair_bases: list[int] = field(default_factory=lambda: [0])

    @property
    def words(self) -> int:
        return self.bases[-1]

    @property
    def pairs(self) -> int:
        return self.pair_bases[-1]


class Levels:
    """The mapped segments of a trie, opened when first needed."""

    def __init__(self, trie: Trie) -> None:
        self.trie, self.shift, self.within = trie, np.uint64(64 - (trie.segments.bit_length() - 1)), np.uint64(hashes_within(trie.segments) - 1)
        self.bases = np.array(trie.bases, np.int64)
        self.first: dict[int, tuple] = {}
        self.second: dict[int, tuple] = {}
        self.third: dict[int, tuple] = {}

    def level1(self, segment: int) -> tuple:
        if segment not in self.first:
            a = map_arrays(f"{self.trie.folder}/words-{segment}")
            self.first[segment] = EliasFano.of(a, "keys"), a["counts"], map_arrays(f"{self.trie.folder}/word-probabilities-{segment}")["probabilities"]
        return self.first[segment]

    def _level(self, name: str, segment: int) -> tuple | None:
        """Contexts, pointers, successors and values; None for a segment that no key fell to."""
        try:
            a = map_arrays(f"{self.trie.folder}/{name}-{segment}")
        except FileNotFoundError:
            return None
        return *(EliasFano.of(a, part) for part in ("contexts", "pointers", "successors")), a.get("probabilities"), tuple(a.get(part) for part in ("counts", "large", "large_counts"))

    def level2(self, segment: int) -> tuple | None:
        if segment not in self.second:
            self.second[segment] = self._level("pairs", segment)
        return self.second[segment]

    def level3(self, segment: int) -> tuple | None:
        if segment not in self.third:
            self.third[segment] = self._level("triples", segment)
        return self.third[segment]

    def find_words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number or -1, count, log10 of the probability) of each distinct, sorted hash."""
        ids, counts, logs = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64), np.full(len(hashes), self.trie.unknown)
        owner = (hashes >> self.shift).astype(np.int64) if self.trie.segments > 1 else np.zeros(len(hashes), np.int64)
        for segment, low, high in _ranges(owner):
            if self.bases[segment + 1] > self.bases[segment]:
                keys, own_counts, own_logs = self.level1(segment)
                at = keys.find(hashes[low:high] & self.within)
                hit = at >= 0
                ids[low:high][hit] = at[hit] + self.bases[segment]
                counts[low:high][hit] = own_counts[at[hit]]
                logs[low:high][hit] = restore(own_logs[at[hit]], self.trie.step)
        return ids, counts, logs

    def word_data(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, log10 of the probability) of sorted word numbers."""
        counts, logs = np.zeros(len(ids), np.int64), np.zeros(len(ids))
        for segment, low, high in _ranges(np.searchsorted(self.bases, ids, "right") - 1):
            _, own_counts, own_logs = self.level1(segment)
            at = ids[low:high] - self.bases[segment]
            counts[low:high], logs[low:high] = own_counts[at], restore(own_logs[at], self.trie.step)
        return counts, logs

    def ranges_of(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the slices of contexts that pairs (contexts: words' numbers) or triples (contexts: pairs' numbers) fall to, and
        the words' numbers from the slices' first."""
        total = max(self.trie.words, 1)
        part = words * SLICES_OF_CONTEXT // total
        return contexts * SLICES_OF_CONTEXT + part, words - (-(-np.arange(SLICES_OF_CONTEXT) * total // SLICES_OF_CONTEXT))[part]

    def segments_of(self, ranges: np.ndarray) -> np.ndarray:
        return (mix(ranges.astype(np.uint64)) % np.uint64(self.trie.segments)).astype(np.int64)

    def _found(self, level, contexts: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, tuple, np.ndarray, np.ndarray]]:
        """For each segment: itself, its data, positions of the keys that it holds, their places in it. The keys come
        in the order of (context, word)."""
        ranges, words = self.ranges_of(contexts, words)
        owner = _small(self.segments_of(ranges), self.trie.segments)
        order = np.argsort(owner, kind="stable")
        for segment, low, high in _ranges(owner[order]):
            at, data = order[low:high], level(segment)
            if data is None:
                continue
            own = ranges[at]
            firsts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            context = data[0].find(own[firsts].astype(np.uint64))
            known = context >= 0
            many = np.diff(np.append(firsts, len(own)))
            at = at[np.repeat(known, many)]
            begin, end = (np.repeat(x.astype(np.int64), many[known]) for x in data[1].access_two(context[known]))
            place = data[2].find_beyond(((words[at] << _spread(end - begin)) + 1).astype(np.uint64), begin, end)
            found = place >= 0
            yield segment, data, at[found], place[found]

    def find_pairs(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, count, log10 of the probability) of each pair; -1, 0 and nan where the trie doesn't hold it.

        Numbers and counts are known in a trie of order 3 only.
        """
        ids, counts, logs = np.full(len(contexts), -1, np.int64), np.zeros(len(contexts), np.int64), np.full(len(contexts), np.nan)
        for segment, data, at, place in self._found(self.level2, contexts, words):
            logs[at] = restore(data[3][place], self.trie.step)
            if self.trie.order > 2:
                ids[at], counts[at] = self.trie.pair_bases[segment] + place, _counts_at(data[4], place)
        return ids, counts, logs

    def pair_ids(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Number of each pair, or -1."""
        ids = np.full(len(contexts), -1, np.int64)
        for segment, _, at, place in self._found(self.level2, contexts, words):
            ids[at] = self.trie.pair_bases[segment] + place
        return ids

    def find_triples(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Count of each triple, 0 where the trie doesn't hold it. contexts: pairs' numbers."""
        out = np.zeros(len(contexts), np.int64)
        for _, data, at, place in self._found(self.level3, contexts, words):
            out[at] = _counts_at(data[4], place)
        return out


_levels: dict[tuple[str, str], Levels] = {}


def opened(trie: Trie, step: str) -> Levels:
    """A worker's levels of a trie, opened once for a step: what a trie knows of itself grows from step to step."""
    if (trie.folder, step) not in _levels:
        _levels.clear()
        _levels[trie.folder, step] = Levels(trie)
    return _levels[trie.folder, step]


def hashes_within(segments: int) -> int:
    """How many hashes fall to a segment of level 1."""
    return 1 << (64 - (segments.bit_length() - 1))


def _spread(many: np.ndarray) -> np.ndarray:
    """Bits by which a range of so many successors is widened: each range gets about as much of the sequence as it has
    successors, so that those of frequent contexts don't lie closer than others."""
    return np.frexp(many - 1)[1]


def _ranges(ordered: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cuts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else []
    for i, low in enumerate(cuts):
        yield int(ordered[low]), int(low), int(cuts[i + 1]) if i + 1 < len(cuts) else len(ordered)


def _small(owner: np.ndarray, segments: int) -> np.ndarray:
    """Numbers of segments in 16 bits where they fit: a stable sort of those goes by their bytes."""
    return owner.astype(np.uint16) if segments <= 1 << 16 else owner


def _with_end(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each text, then the end token; and the number of tokens of each text."""
    lengths = counts + 1
    ends = np.cumsum(lengths) - 1
    tokens = np.empty(len(hashes) + len(counts), np.uint64)
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner], tokens[ends] = hashes, _END
    return tokens, lengths


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0)):
            yield _with_end(*word_hashes(data, offsets))[0]


def _emit(pending: list[np.ndarray], segment_of, segments: int) -> Iterator[pa.RecordBatch]:
    keys, counts = _count(np.concatenate(pending))
    owner = _small(segment_of(keys), segments)
    order = np.argsort(owner, kind="stable")
    owner, keys, counts = owner[order], keys[order], counts[order]
    del order
    held: list[tuple[int, bytes, bytes]] = []
    for s, low, high in _ranges(owner):
        held.append((s, _planes(keys[low:high]), np.ascontiguousarray(counts[low:high].view(np.uint8).reshape(-1, 8).T).tobytes()))
        if len(held) == 64 or high == len(keys):
            s, k, c = zip(*held, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], names=["segment", "keys", "counts"])
            held = []


def _merge(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a segment's partial counts, in one pass over arrays of known size."""
    total = sum(map(len, rows["keys"])) // 8
    keys, counts, at = np.empty(total, np.uint64), np.empty(total, np.uint64), 0
    for k, c in zip(rows["keys"], rows["counts"], strict=True):
        end = at + len(k) // 8
        keys[at:end], counts[at:end] = _keys(k), np.frombuffer(c, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()
        at = end
    return _count(keys, counts)


def build_trie(docs: DataFrame, segments: int | None = None, prior: float = PRIOR, order: int = ORDER, segment_bytes: int = SEGMENT_BYTES) -> Trie:
    """Learn from the column text of docs. segments: a power of two, by default one for segment_bytes of text. order: 2 or 3."""
    spark = docs.sparkSession
    texts = docs.select("text")
    if segments is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        segments = 1 << (max(FEWEST_SEGMENTS, size // segment_bytes) - 1).bit_length()
    folder = shared_dir(spark, "trie")
    shift = np.uint64(64 - (segments.bit_length() - 1))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size = [], 0
        for tokens in _tokens(batches):
            pending.append(tokens)
            size += len(tokens)
            if size >= PENDING:
                yield from _emit(pending, lambda k: (k >> shift).astype(np.int64), segments)
                pending, size = [], 0
        if pending:
            yield from _emit(pending, lambda k: (k >> shift).astype(np.int64), segments)

    counted = texts.mapInArrow(count_words, _COUNTS).groupBy("segment")
    totals_schema = "segment int, distinct_keys long, tokens long, once long, twice long"

    def totals(rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merge(rows)
        segment = int(rows["segment"].iloc[0])
        within = hashes_within(segments)
        write_arrays(f"{folder}/words-{segment}", EliasFano.build(keys & np.uint64(within - 1), within).arrays("keys") | {"counts": counts.astype(np.uint32 if counts.max() < 1 << 32 else np.uint64)})
        return pd.DataFrame([(segment, len(keys), int(counts.sum()), int((counts == 1).sum()), int((counts == 2).sum()))], columns=["segment", "distinct_keys", "tokens", "once", "twice"])

    found = {row["segment"]: row for row in counted.applyInPandas(totals, totals_schema).collect()}  # one row per segment
    bases = [0]
    for s in range(segments):
        bases.append(bases[-1] + (found[s]["distinct_keys"] if s in found else 0))
    tokens, once, twice = (sum(row[k] for row in found.values()) for k in ("tokens", "once", "twice"))
    discount = once / (once + 2 * twice) if once and twice else DISCOUNT_DEFAULT
    mass = discount * bases[-1] / tokens if tokens else 1.0
    unseen = max(once * (once - 1) / (2 * (twice + 1)), 1.0)
    step = (np.log10(tokens + prior) - np.log10(1 - discount) + 0.1) / 255 if tokens else 1.0  # the least is (1 - discount) / tokens
    trie = Trie(folder, segments, bases, tokens, float(np.log10(max(mass, 1e-12) / unseen)), prior, order, float(step))
    if not tokens:
        return trie
    keys_fit(trie.words, trie.words)

    def finish_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for segment in batch["segment"]:
                logs = np.log10((map_arrays(f"{folder}/words-{segment}")["counts"] - discount) / tokens)
                write_arrays(f"{folder}/word-probabilities-{segment}", {"probabilities": quantise(logs, trie.step)})
            yield batch

    full = spark.createDataFrame([(s,) for s in sorted(found)], "segment int").repartition(min(len(found), 64), "segment")
    full.mapInPandas(finish_words, "segment int").foreach(lambda _: None)

    def split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        contexts = keys // np.uint64(trie.words)
        return contexts.astype(np.int64), (keys - contexts * np.uint64(trie.words)).astype(np.int64)

    def gather(batches: Iterator[pa.RecordBatch], keys_of) -> Iterator[pa.RecordBatch]:
        levels, words = Levels(trie), np.uint64(trie.words)
        owner = lambda k: levels.segments_of(levels.ranges_of(*split(k))[0])
        pending, size = [], 0
        for block in _blocks(_tokens(batches)):
            distinct, where = np.unique(block, return_inverse=True)
            # blocks are whole texts, each closed by the end token, which is also the first word's context
            ids = levels.find_words(distinct)[0][where].astype(np.uint64)
            pending.append(keys_of(levels, block, np.concatenate([ids[-1:], ids[:-1]]) * words + ids, ids))
            size += len(pending[-1])
            if size >= PENDING:
                yield from _emit(pending, owner, segments)
                pending, size = [], 0
        if pending:
            yield from _emit(pending, owner, segments)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gather(batches, lambda levels, block, pairs, ids: pairs)

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.uint64(trie.words)

        def keys_of(levels: Levels, block: np.ndarray, pairs: np.ndarray, ids: np.ndarray) -> np.ndarray:
            distinct, where = np.unique(pairs, return_inverse=True)
            numbers = levels.pair_ids((distinct // words).astype(np.int64), (distinct % words).astype(np.int64))[where]
            inner = np.flatnonzero(block[:-1] != _END)  # the last of the context; a text's first word has no pair before it
            return numbers[inner].astype(np.uint64) * words + ids[inner + 1]

        return gather(batches, keys_of)

    def write_level(name: str, segment: int, contexts: np.ndarray, universe: int, words: np.ndarray, values: dict[str, np.ndarray]) -> None:
        """contexts, words: of each key, in order."""
        ranges, words = Levels(trie).ranges_of(contexts, words)
        begins = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]]))
        ends = np.append(begins[1:], len(ranges))
        many, spread = ends - begins, _spread(ends - begins)
        widths = (words[ends - 1] << spread) + 1  # the greatest successor's value within its range
        successors = np.repeat(np.cumsum(widths) - widths, many) + (words << np.repeat(spread, many)) + 1
        parts = {
            "contexts": (ranges[begins], universe * SLICES_OF_CONTEXT),
            "pointers": (np.append(0, ends), len(words) + 1),
            "successors": (successors, int(widths.sum()) + 1),
        }
        arrays = [EliasFano.build(x.astype(np.uint64), size).arrays(part) for part, (x, size) in parts.items()]
        write_arrays(f"{folder}/{name}-{segment}", arrays[0] | arrays[1] | arrays[2] | values)

    def finish_pairs(rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merge(rows)
        segment, levels = int(rows["segment"].iloc[0]), opened(trie, "pairs")
        contexts, words = split(keys)
        context_counts = levels.word_data(contexts)[0]
        distinct, where = np.unique(words, return_inverse=True)
        singles = 10 ** levels.word_data(distinct)[1][where]
        logs = np.log10((counts + prior * singles) / (context_counts + prior))
        write_level("pairs", segment, contexts, trie.words, words, {"probabilities": quantise(logs, trie.step)} | (_narrow(counts) if order > 2 else {}))
        return pd.DataFrame([(segment, len(keys))], columns=["segment", "pairs"])

    def finish_triples(rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merge(rows)
        segment = int(rows["segment"].iloc[0])
        contexts, words = split(keys)
        write_level("triples", segment, contexts, trie.pairs, words, _narrow(counts))
        return pd.DataFrame([(segment, len(keys))], columns=["segment", "triples"])

    def build(name: str, count, finish) -> list[int]:
        """Keys before each segment of the level."""
        built = texts.mapInArrow(count, _COUNTS).groupBy("segment").applyInPandas(finish, f"segment int, {name} long")
        have = {row["segment"]: row[name] for row in built.collect()}  # one row per segment
        return np.cumsum([0, *(have.get(s, 0) for s in range(segments))]).tolist()

    trie.pair_bases = build("pairs", count_pairs, finish_pairs)
    if order > 2:
        keys_fit(trie.pairs, trie.words)
        build("triples", count_triples, finish_triples)
    return trie


def keys_fit(contexts: int, words: int) -> None:
    """A key is the number of a context and of a word in one signed 64-bit number: an error where they don't fit."""
    if contexts * words >= 1 << 63:
        raise OverflowError(f"{contexts} contexts of {words} words have no 64-bit keys; a lower order has")


def _narrow(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in a byte each; 255 stands for those from there on, which are listed with their places."""
    large = np.flatnonzero(counts >= 255)
    return {"counts": np.minimum(counts, 255).astype(np.uint8), "large": large, "large_counts": counts[large]}


def _counts_at(arrays: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
    counts, large, large_counts = arrays
    out = counts[at].astype(np.int64)
    if len(more := np.flatnonzero(out == 255)):
        out[more] = large_counts[np.searchsorted(large, at[more])]
    return out


def _blocks(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Runs of whole texts, of TOGETHER tokens and more but for the last."""
    held, size = [], 0
    for tokens in parts:
        held.append(tokens)
        size += len(tokens)
        if size >= TOGETHER:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def _score_block(levels: Levels, tokens: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    trie = levels.trie
    distinct, where = np.unique(tokens, return_inverse=True)
    # what depends on one word alone is reckoned once a distinct word
    word_ids, word_counts, logs = levels.find_words(distinct)
    ids = word_ids[where]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    known = np.add.reduceat((word_counts > 0).astype(np.int64)[where], starts)
    base = np.add.reduceat(np.log10((word_counts + 1) / (trie.tokens + trie.words + 1))[where], starts)
    if not trie.tokens:
        return [lengths, known, base, base]
    backing_off = np.where(word_ids >= 0, np.log10(trie.prior / (word_counts + trie.prior)), 0.0)
    score = logs[where] + np.roll(backing_off[where], 1)
    del distinct, where  # a block's arrays are most of a worker's memory
    before = np.roll(ids, 1)
    both = np.flatnonzero((ids >= 0) & (before >= 0))
    pairs, which = np.unique(before[both] * trie.words + ids[both], return_inverse=True)
    del before
    numbers, pair_counts, pair_logs = levels.find_pairs(pairs // trie.words, pairs % trie.words)
    pair_logs = pair_logs[which]
    hit = ~np.isnan(pair_logs)
    score[both[hit]] = pair_logs[hit]
    del pairs, pair_logs, hit
    if trie.order > 2:
        pair_before, count_before = np.full(len(ids), -1, np.int64), np.zeros(len(ids), np.int64)
        pair_before[both], count_before[both] = numbers[which], pair_counts[which]
        del both, which, numbers, pair_counts
        pair_before, count_before = np.roll(pair_before, 1), np.roll(count_before, 1)
        pair_before[starts] = -1  # a text's first word has no pair before it
        at = np.flatnonzero(pair_before >= 0)
        count_before = count_before[at]
        triple_counts, inner = np.zeros(len(at), np.int64), np.flatnonzero(ids[at] >= 0)
        triples, which = np.unique(pair_before[at[inner]] * trie.words + ids[at[inner]], return_inverse=True)
        del pair_before, ids
        triple_counts[inner] = levels.find_triples(triples // trie.words, triples % trie.words)[which]
        score[at] = np.log10((triple_counts + trie.prior * np.exp(score[at] * np.log(10))) / (count_before + trie.prior))
    return [lengths, known, base, np.add.reduceat(score, starts)]


def score_texts(docs: DataFrame, trie: Trie) -> DataFrame:
    """docs with lm: n_tokens, n_known, base_score and score (both log10)."""

    @pandas_udf("n_tokens long, n_known long, base_score double, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        levels = opened(trie, "score")
        for batch in batches:
            parts, held, size = [], [], 0
            for _, _, data, offsets in slices(pa.array(batch, pa.large_string())):
                held.append(_with_end(*word_hashes(data, offsets)))
                size += len(held[-1][0])
                if size >= TOGETHER:
                    block = [np.concatenate(x) for x in zip(*held, strict=True)]
                    held, size = [], 0
                    parts.append(_score_block(levels, *block))
            if held:
                parts.append(_score_block(levels, *(np.concatenate(x) for x in zip(*held, strict=True))))
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [[]] * 4
            yield pd.DataFrame(dict(zip(("n_tokens", "n_known", "base_score", "score"), columns, strict=True)))

    return docs.withColumn("lm", score("text"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    trie = build_trie(docs.filter(~held_out))
    scored = score_texts(docs, trie)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "lm.n_tokens", "lm.n_known", F.lit(trie.tokens).cast("long").alias("train_tokens"), "lm.base_score", "lm.score"
    )
