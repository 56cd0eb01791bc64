"""Packing token sequences shortest-pack-first over the histogram of piece lengths.

Documents are tokenised and cut into pieces of at most ``size`` ids: full pieces, then the rest. The lengths'
histogram (at most ``size`` rows) is packed on the driver: lengths from the longest down, each into the
shortest packs that there are, whole groups of packs at a time; what comes out is a short list of patterns with
counts. Pieces are then ranked within their length, and ranges of ranks lead each piece to its place in a
pattern.

Cases: a null or empty text is the single closing id; repeated rows are packed each; an empty table gives an
empty result; documents of any length are cut, never truncated; of the input's columns only doc_id is kept.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, salted_rank, settings
from .words import give_back, slices

SIZE, CLOSING_ID = 2048, 1
#: Distinct words, and bytes of words and ids, that a worker keeps before it lets those go that didn't recur; bytes of text encoded at once.
CACHE_WORDS, CACHE_BYTES, TOGETHER, WORDS_A_CALL = 200_000, 48 << 20, 2 << 20, 10_000
#: Texts go to a worker in batches of so many bytes; after so many bytes of text it returns what it has freed.
BATCH_CONF, GIVE_BACK = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}, 16 << 20
#: A control character that is one token; signs that the tokenizer parts from a letter or digit before them.
PARTING = "\x1e"
_SIGN, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: A tokenizer is read word by word only if it gives the same ids so for these.
PROBES = (
    "Hello, World! It's a-b C++ (x) 3.14, 1,000.50 don't_x; <|end|> [MASK] </s> #tag @you",
    "\u00c9T\u00c9 na\u00efve Stra\u00dfe, \u00d1and\u00fa. \u201cquoted\u201d \u2014 \u20ac5! \u00a0 \u4f60\u597d\uff0c\u4e16\u754c\u3002 \U0001f600!! \u0130x i\u0307",
    " a  b\t\tc\n\nd \x1e e\x00f ... --- ,a .b 'c' \"d\" e'f g's h're AbC ABC abc aBc a1b2 1a 2b",
)
_encoders: dict[str, TextEncoder] = {}


class TextEncoder:
    """Ids of texts. Where the tokenizer's pattern drops white space and lets no token span it (see PROBES), a
    text's ids are its words' ids, and most words recur; any other tokenizer is given whole texts."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parting = self._ids(PARTING)
        self.parting_id = int(parting[0]) if len(parting) == 1 else None
        self.by_word, self.parts = False, False
        self._clear()
        for parts in (True, False):
            if not self.by_word and self.parting_id is not None:
                self.parts = parts
                self._clear()
                self.by_word = all(np.array_equal(self._words(pa.array([t], pa.large_string()))[0], self._ids(t)) for t in PROBES)

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.starts, self.lengths, self.ids, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), 0
        self.again = np.zeros(0, bool)

    def _trim(self) -> None:
        """Keep the words that were met again since they were learned or last kept, all of them or, above half the bounds, none."""
        kept = [(w, i) for w, i in self.number.items() if self.again[i]]
        starts, lengths = self.starts, self.lengths
        ids, at = self.ids, np.fromiter((i for _, i in kept), np.int64, len(kept))
        self._clear()
        if 2 * len(kept) <= CACHE_WORDS:
            ids, lengths = _gather(ids, starts[at], lengths[at])
            self._keep([w for w, _ in kept], ids, np.cumsum(lengths) - lengths, lengths)
            if 2 * self.bytes > CACHE_BYTES:
                self._clear()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, words: list[str]) -> None:
        """Keep the ids of new words without PARTING, of some thousands from one call: that character, one token of its
        own, parts them. (A call holds about a hundred times the bytes of its ids.)"""
        for low in range(0, len(words), WORDS_A_CALL):
            part = words[low : low + WORDS_A_CALL]
            ids = self._ids(f" {PARTING} ".join(part))
            cuts = np.flatnonzero(ids == self.parting_id)
            starts, ends = np.append(0, cuts + 1), np.append(cuts, len(ids))
            self._keep(part, ids, starts, ends - starts)

    def _keep(self, words: list[str], ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.starts), len(self.starts) + len(words)), strict=True))
        self.starts, self.lengths, self.ids = np.concatenate([self.starts, starts + len(self.ids)]), np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, ids])
        self.again = np.concatenate([self.again, np.zeros(len(words), bool)])
        self.bytes += sum(map(len, words)) + ids.nbytes

    def _split(self, words: pa.LargeStringArray) -> pa.LargeStringArray:
        """Each word as two parts, lower-cased: without the signs at its end, and the signs."""
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        last = np.maximum.accumulate(np.where(_SIGN[data], -1, np.arange(len(data)))) if len(data) else np.zeros(1, np.int64)
        core = np.maximum(last[np.maximum(ends[1:] - 1, 0)], 0)  # the last byte that is no sign
        byte, before = data[core] if len(data) else core, data[np.maximum(core - 1, 0)] if len(data) else core
        letter = _LETTER[byte] | ((before == 0xC3) & (byte >= 0x80) & (byte != 0x97) & (byte != 0xB7))
        middle = np.where((core >= ends[:-1]) & (core < ends[1:]) & letter, core + 1, ends[1:])
        offsets = np.append(np.stack([ends[:-1], middle], axis=1).ravel(), ends[-1])
        return pc.ascii_lower(pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(offsets.astype(np.int64)), words.buffers()[2] or pa.py_buffer(b"")))

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        if len(self.number) > CACHE_WORDS or self.bytes > CACHE_BYTES:
            self._trim()
        distinct = words.dictionary
        parts = (self._split(distinct) if self.parts else distinct).dictionary_encode()
        found = parts.dictionary.to_numpy(zero_copy_only=False)
        at = np.array([self.number.get(w, -1) for w in found], np.int64)
        self.again[at[at >= 0]] = True
        if len(fresh := np.flatnonzero(at < 0)):
            new = [w if PARTING not in w else " " for w in found[fresh].tolist()]  # those are encoded whole below
            at[fresh] = np.arange(len(self.starts), len(self.starts) + len(new))
            self._learn(new)
        at = at[parts.indices.to_numpy()].reshape(len(distinct), -1)
        ids, lengths = _gather(self.ids, self.starts[at].ravel(), self.lengths[at].ravel())
        lengths = lengths.reshape(at.shape).sum(axis=1)
        starts = np.cumsum(lengths) - lengths
        special = pc.or_(pc.match_substring(distinct, PARTING), pc.match_substring(distinct, "<|"))
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            own = self._ids(distinct[i].as_py())
            starts[i], lengths[i], ids = len(ids), len(own), np.concatenate([ids, own])
        of = words.indices.to_numpy()
        flat, counts = _gather(ids, starts[of], lengths[of])
        ends, bounds = np.concatenate([[0], np.cumsum(counts)]), split.offsets.to_numpy()
        return flat, np.diff(ends[bounds - bounds[0]])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts end to end, number of ids of each)."""
        if self.by_word:
            return self._words(texts)
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate(found) if found else np.zeros(0, np.uint32), np.fromiter(map(len, found), np.int64, len(found))


def _encoder(path: str) -> TextEncoder:
    """The worker's own encoder, kept while it lives. (A function of the module, as what is sent with a task has its own copy of the
    module's variables.)"""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def _gather(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of ids end to end, and their lengths."""
    ends = np.cumsum(lengths)
    return ids[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths


def _cut(ids: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(document, start, ids) of the pieces of documents laid end to end."""
    closed = lengths + 1
    ends = np.cumsum(closed)
    flat = np.full(int(ends[-1]), CLOSING_ID, "<u4")
    inner = np.ones(len(flat), bool)
    inner[ends - 1] = False
    flat[inner] = ids
    many = -(-closed // size)
    rows = np.repeat(np.arange(len(lengths)), many)
    starts = (np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)) * size
    offsets = np.append((ends - closed)[rows] + starts, len(flat)) * 4
    return rows, starts, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)])


def tokenised_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """doc_id, start, length, doc_tokens and ids (little-endian 32-bit) of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held = _encoder(tokenizer), 0
        for batch in batches:
            for low, high, data, _ in slices(batch.column(1), TOGETHER):
                held += len(data)
                texts = pc.fill_null(batch.column(1).slice(low, high - low).cast(pa.large_string()), "")
                ids, lengths = encoder.encode(texts)
                rows, starts, pieces = _cut(ids, lengths, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low).take(pa.array(rows)), pa.array(starts, pa.int64()), pa.array(np.minimum(size, lengths[rows] + 1 - starts), pa.int32()), pa.array(lengths[rows] + 1, pa.int64()), pieces.cast(pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "ids"],
                )
                if held > GIVE_BACK:
                    held = 0
                    give_back()
        give_back()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length int, doc_tokens long, ids binary")


def shortest_pack_first(histogram: Mapping[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) with their counts.

    Each step uses up a length or a group of packs, so there are at most twice as many patterns as lengths.
    """
    packs: list[tuple[int, int, tuple[int, ...], int]] = []  # (filled, order, lengths, count), the shortest on top
    order = 0
    for length in sorted(histogram, reverse=True):
        left, grown = histogram[length], []
        while left:
            if packs and packs[0][0] + length <= size:
                filled, _, lengths, count = heapq.heappop(packs)
                taken = min(left, count)
                if count > taken:
                    order += 1
                    heapq.heappush(packs, (filled, order, lengths, count - taken))
                grown = (filled + length, lengths + (length,), taken)
            else:
                taken, grown = left, (length, (length,), left)
            order += 1
            heapq.heappush(packs, (grown[0], order, grown[1], grown[2]))
            left -= taken
    return [(lengths, count) for _, _, lengths, count in sorted(packs)]


def placements(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset in the sequence, pieces a sequence): ranges of
    ranks within a length, each for one pattern."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, count in patterns:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            many = lengths.count(length)
            first = used.get(length, 0)
            used[length] = first + many * count
            out.append((length, first, used[length], sequence, offset, many))
            offset += many * length
        sequence += count
    return out


def place(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces(doc_id, start, length, ...) with sequence_id and offset."""
    histogram = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = pieces.sparkSession.createDataFrame(
        placements(shortest_pack_first(histogram, size)), "length int, _first long, _end long, _sequence long, _offset long, _many long"
    )
    ranked = salted_rank(pieces, ["length"], [F.col("doc_id"), F.col("start")], F.xxhash64("doc_id", "start"), "_rank")
    # the plan's rows are bounded by the number of lengths, whatever the input
    placed = ranked.join(F.broadcast(plan), "length").filter("_rank >= _first AND _rank < _end")
    step = F.col("_rank") - F.col("_first")
    return placed.select(
        *pieces.columns,
        (F.col("_sequence") + F.floor(step / F.col("_many"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (step % F.col("_many")) * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """Pieces of docs with their ids and places: doc_id, start, length, doc_tokens, ids, sequence_id, offset."""
    with settings(docs.sparkSession, BATCH_CONF):
        pieces = materialise(tokenised_pieces(docs, tokenizer, size), "pieces")
    return place(pieces, size)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def digest_pieces(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest_pieces(pack(docs, default_tokenizer()))
