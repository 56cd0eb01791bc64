"""Language identification by a linear-chain conditional random field over the words of a text.

A word's features are its hashed character n-grams (2 to 4 characters), those at its ends being its affixes, the
word itself, and the lexicons that hold it: each language's words that occur in its training texts nearly alone.
What has more than ``WIDEST`` letters between white space, as text written without spaces does, is cut into windows
over its whole length, each a word of its own.
Transitions between the labels of neighbouring words are learned with the features' weights, by the gradient of
the conditional likelihood (forward-backward) on whole lines. A text gets the language with
the greatest sum of its words' posterior probabilities, which label code-switched text word by word; the score
is their mean.

Fitting uses at most ``most_rows`` documents of each language and ``most_bytes`` of their texts (those with the least hash), in
one task on an executor; the driver gets the model. Texts above a quarter of these bytes are passed over; of a language that has no
others, its shortest text is learned from. More than ``MOST_LANGUAGES`` languages are an error, not a cut.

Cases: null texts and texts without a letter get ``und`` and score 0; with nothing to learn from, all get
``und``; with one language to learn from, that one; repeated rows count each; an empty table gives an empty
result; extra columns are kept.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .shared import materialise

MOST_ROWS, MOST_BYTES, MOST_LANGUAGES, EPOCHS = 400, 1 << 21, 64, 30
BITS, WIDEST, NGRAM, CACHE_WORDS = 18, 62, 4, 300_000
LEXICON_SHARE, LEXICON_COUNT = 0.9, 3
#: Letters, times languages, that are labelled together (a longer text by itself).
SLICE_LETTERS = 16 << 20
UNKNOWN = "und"


def letters_of(word: str) -> str:
    """The word's letters, lower-cased; other characters at its ends and inside it say nothing of language."""
    return (word if word.isalpha() else "".join(c for c in word if c.isalpha())).lower()


def windows(word: str) -> list[str]:
    """The word, or if it has more than WIDEST letters, windows of them of like length that share NGRAM - 1 with
    the next, so that each n-gram lies in one of them."""
    if 2 * len(word) <= WIDEST:  # no letter has more than two in lower case
        return [word]
    letters = word if word.isalpha() else "".join(c for c in word if c.isalpha())
    longer = len(letters.lower())
    if longer <= WIDEST:
        return [word]
    shared = NGRAM - 1
    width, rest = (WIDEST if longer == len(letters) else WIDEST // 2) - shared, max(len(letters) - shared, 1)
    many = -(-rest // width)
    return [letters[rest * i // many : rest * (i + 1) // many + shared] for i in range(many)]


def _codes(words: list[str], width: int) -> np.ndarray:
    return np.array([f"\x02{w}\x03" for w in words], dtype=f"<U{width}").view(np.uint32).reshape(len(words), width).astype(np.int64)


def _hashed(number: np.ndarray) -> np.ndarray:
    number = number * 0x2545F4914F6CDD1D
    return (number ^ (number >> 29)) & ((1 << BITS) - 1)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, first feature of each word), by words."""
    lengths = np.minimum(np.fromiter(map(len, words), np.int64, len(words)), WIDEST) + 2
    rows, numbers = [], []
    for low, high in ((0, 6), (6, 10), (10, 16), (16, 28), (28, WIDEST + 1)):
        at = np.flatnonzero((lengths - 2 >= low) & (lengths - 2 < high))
        if not len(at):
            continue
        width = high + 1
        codes = _codes([words[i][:WIDEST] for i in at], width)
        for n in (2, 3, 4):
            number = np.full((len(at), width - n + 1), n, np.int64)
            for j in range(n):
                number = number * 1_000_003 + codes[:, j : width - n + 1 + j]
            held = codes[:, n - 1 :] > 0
            numbers.append(_hashed(number)[held])
            rows.append(np.broadcast_to(at[:, None], held.shape)[held])
        whole = np.full(len(at), 9, np.int64)
        for j in range(width):
            whole = whole * 1_000_003 + codes[:, j]
        numbers.append(_hashed(whole))
        rows.append(at)
    rows, numbers = np.concatenate(rows), np.concatenate(numbers)
    order = np.argsort(rows, kind="stable")
    return numbers[order], np.searchsorted(rows[order], np.arange(len(words)))


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # features x languages
    transitions: np.ndarray
    lexicon: dict[str, int]
    lexicon_weights: np.ndarray  # lexicons x languages

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.languages)))
        numbers, first = features(words)
        out = np.add.reduceat(self.weights[numbers], first, axis=0).astype(np.float64)
        listed = np.array([self.lexicon.get(w, -1) for w in words])
        out[listed >= 0] += self.lexicon_weights[listed[listed >= 0]]
        return out


def posteriors(emissions: np.ndarray, transitions: np.ndarray, lengths: np.ndarray, fitting: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each word of chains laid end to end, and, where it's for fitting, the expected label pairs of neighbours."""
    k = emissions.shape[1]
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    local = np.exp(emissions - emissions.max(axis=1, keepdims=True)) if len(emissions) else emissions
    step = np.exp(transitions - transitions.max())
    alpha, beta, pairs = np.empty_like(local), np.empty_like(local), np.zeros((k, k))
    for t in range(int(sizes[0]) if len(sizes) else 0):
        at = starts[: np.searchsorted(-sizes, -t, "left")] + t
        a = local[at] if t == 0 else (alpha[at - 1] @ step) * local[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    for t in range(int(sizes[0]) - 1 if len(sizes) else -1, -1, -1):
        n = np.searchsorted(-sizes, -t, "left")
        longer = np.searchsorted(-sizes, -(t + 1), "left")
        at = starts[:n] + t
        beta[at[longer:]] = 1.0
        if longer:
            after = local[at[:longer] + 1] * beta[at[:longer] + 1]
            b = after @ step.T
            if fitting:
                total = (alpha[at[:longer]] * b).sum(axis=1, keepdims=True)
                pairs += (alpha[at[:longer]] / total).T @ after * step
            beta[at[:longer]] = b / b.sum(axis=1, keepdims=True)
    out = alpha * beta
    return out / out.sum(axis=1, keepdims=True), pairs


def chains(text: str) -> Iterator[list[str]]:
    for line in text.split("\n"):
        words = line.split()
        if len(line) > WIDEST // 2:
            words = [part for word in words for part in windows(word)]
        if words:
            yield words


def fit(texts: Iterable[str | None], langs: Iterable[str], epochs: int = EPOCHS) -> LanguageModel | None:
    langs = list(langs)
    languages = sorted(set(langs))
    if not languages:
        return None
    number: dict[str, int] = {}
    words, lengths, truth = [], [], []
    for text, lang in zip(texts, langs, strict=True):
        label = languages.index(lang)
        for chain in chains(text or ""):
            own = [number.setdefault(w, len(number)) for w in map(letters_of, chain) if w]
            if own:
                words += own
                lengths.append(len(own))
                truth.append(label)
    k, vocabulary = len(languages), list(number)
    if not words:
        return LanguageModel(languages, np.zeros((1 << BITS, k), np.float32), np.zeros((k, k)), {}, np.zeros((k, k)))
    words, lengths = np.array(words), np.array(lengths)
    label = np.repeat(np.array(truth), lengths)
    counts = np.zeros((len(vocabulary), k))
    np.add.at(counts, (words, label), 1)
    share = counts.max(axis=1) / counts.sum(axis=1)
    listed = {vocabulary[i]: int(counts[i].argmax()) for i in range(len(vocabulary)) if share[i] >= LEXICON_SHARE and counts[i].sum() >= LEXICON_COUNT}
    numbers, first = features(vocabulary)
    many = np.diff(np.append(first, len(numbers)))
    lists = np.array([listed.get(w, -1) for w in vocabulary])
    weights, transitions, lexical = np.zeros((1 << BITS, k)), np.zeros((k, k)), np.zeros((k, k))
    state = [np.full_like(x, 1e-6) for x in (weights, transitions, lexical)]
    seen_pairs = np.diag(np.bincount(np.array(truth), lengths - 1, k))
    for _ in range(epochs):
        emissions = np.add.reduceat(weights[numbers], first, axis=0)
        emissions[lists >= 0] += lexical[lists[lists >= 0]]
        posterior, pairs = posteriors(emissions[words], transitions, lengths)
        gap = counts.copy()
        for j in range(k):
            gap[:, j] -= np.bincount(words, posterior[:, j], len(vocabulary))
        gap /= len(words)
        spread = np.stack([np.bincount(numbers, np.repeat(gap[:, j], many), 1 << BITS) for j in range(k)], axis=1)
        by_list = np.zeros((k, k))
        np.add.at(by_list, lists[lists >= 0], gap[lists >= 0])
        for value, slope, size, past in zip((weights, transitions, lexical), (spread - 1e-7 * weights, (seen_pairs - pairs) / len(words) - 1e-3 * transitions, by_list), (0.15, 0.3, 0.15), state, strict=True):
            past += slope * slope
            value += size * slope / np.sqrt(past)
    return LanguageModel(languages, weights.astype(np.float32), transitions, listed, lexical)


def training_rows(docs: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, text and lang of at most most_rows documents and most_bytes of text of each language, those with the
    least hash; rows that repeat both id and language count once (the least text)."""
    known = docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL").filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    sizes = known.groupBy("lang", "doc_id").agg(F.min(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes")).withColumn("order", F.xxhash64("doc_id"))
    # a long text would take up the bytes of all after it; with no others in the language, the shortest is its sample
    sizes = sizes.withColumn("long", F.col("bytes") > most_bytes // 4).withColumn("order", F.when(F.col("long"), F.col("bytes")).otherwise(F.col("order")))
    order = ("long", "order", "doc_id")
    # the first of each language, from the first of each part of it: no task ranks a whole language
    part = Window.partitionBy("lang", F.pmod("doc_id", F.lit(256))).orderBy(*order)
    some = sizes.withColumn("n", F.row_number().over(part)).filter(F.col("n") <= most_rows)
    whole = Window.partitionBy("lang").orderBy(*order)
    within = F.when(F.col("long"), F.col("n") == 1).otherwise(F.col("sum") <= most_bytes)
    chosen = some.withColumns({"n": F.row_number().over(whole), "sum": F.sum("bytes").over(whole)}).filter((F.col("n") <= most_rows) & within)
    chosen = chosen.select("lang", "doc_id", "bytes")  # at most most_rows for each of the languages
    fits = known.select("doc_id", "text", "lang").join(F.broadcast(chosen), ["lang", "doc_id"]).filter(F.octet_length(F.coalesce("text", F.lit(""))) == F.col("bytes"))
    return fits.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def fit_rows(rows: DataFrame) -> LanguageModel | None:
    """fit() in one task, over rows within bounds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if parts := list(batches):
            found = pd.concat(parts).sort_values(["doc_id", "lang"])
            if found["lang"].nunique() > MOST_LANGUAGES:
                raise ValueError(f"more than {MOST_LANGUAGES} languages")
            model = fit(found["text"], found["lang"])
            yield pd.DataFrame({"model": [zlib.compress(pickle.dumps(model), 1)]})

    found = materialise(rows.repartition(1).mapInPandas(run, "model binary"), "language-model").collect()
    return pickle.loads(zlib.decompress(found[0]["model"])) if found else None


def language(model: LanguageModel | None) -> Column:
    """lang_pred and score of the column text."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = model_broadcast(model)

    @pandas_udf("lang_pred string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        names = np.array(own.languages, dtype=object)
        known: dict[str, int] = {}
        table = np.zeros((0, len(names)))
        for batch in batches:
            parts = []
            # many chains together: each of the sweep's steps takes one word of all
            upto = batch.str.len().fillna(0).cumsum().to_numpy(np.int64) * len(names) // SLICE_LETTERS
            cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(batch)] if len(batch) else [0]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                texts = [[chain for chain in chains(t)] if t else [] for t in batch.iloc[low:high]]
                new = set().union(*(c for t in texts for c in t)).difference(known)
                if len(known) + len(new) > CACHE_WORDS:
                    known, table = {}, table[:0]
                    new = set().union(*(c for t in texts for c in t))
                new = list(new)
                plain = [letters_of(w) for w in new]
                has = [i for i, w in enumerate(plain) if w]
                known.update((new[i], len(table) + n) for n, i in enumerate(has))
                known.update((w, -1) for w, p in zip(new, plain, strict=True) if not p)
                table = np.concatenate([table, own.emissions([plain[i] for i in has])])
                ids = [[i for w in chain if (i := known[w]) >= 0] for t in texts for chain in t]
                owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
                lengths = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((i for c in ids for i in c), np.int64, int(lengths.sum()))
                sums, many = np.zeros((len(texts), len(names))), np.zeros(len(texts))
                if len(flat):
                    posterior, _ = posteriors(table[flat], own.transitions, lengths[lengths > 0], fitting=False)
                    word_owner = np.repeat(owner, lengths)
                    many = np.bincount(word_owner, minlength=len(texts))
                    for j in range(len(names)):
                        sums[:, j] = np.bincount(word_owner, posterior[:, j], len(texts))
                best = sums.argmax(axis=1)
                parts.append(pd.DataFrame({"lang_pred": np.where(many > 0, names[best], UNKNOWN), "score": np.minimum(sums.max(axis=1) / np.maximum(many, 1), 1.0)}))
            yield pd.concat(parts) if parts else pd.DataFrame({"lang_pred": [], "score": []})

    return label(F.col("text"))


def model_broadcast(model: LanguageModel):
    """The model (a few MB, bounded by BITS and the rows of the fit) as a broadcast variable."""
    return SparkSession.active().sparkContext.broadcast(model)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = docs.withColumn("_l", language(fit_rows(training_rows(docs))))
    return found.select("doc_id", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1).alias("held_out"), "_l.lang_pred", "_l.score")
