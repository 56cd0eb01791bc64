"""Toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks.

A document is a bag of sentences, a sentence a run of phrases: its words and its pairs of neighbouring words, with
the marks at their ends. The kernel compares two phrases by the runs of three and four characters that they share
in order, with other characters between neighbours allowed, each halving the weight: so an insult with a letter
inserted or left out stays close to the one it came from, and one of two ordinary words can be told from either. Case, look-alike
digits and punctuation are folded first (``read``), and words written apart letter by letter are put together. A phrase
is a vector of kernel values with landmark phrases, whitened by the landmarks' own kernel matrix (Nyström), over the
norm that a phrase of its length has if no subsequence recurs in it. A sentence scores as its worst phrase (over a
whole long sentence the kernel would be diluted by its harmless words), a document as its worst sentence.

Labels are given by document, so which sentence earned one is latent (multiple instances). Phrases that toxic
documents hold at ``RATIO`` times the rate of clean ones, too often to be chance, are the first guess, the foremost
also with a character put in. Each round then fits a squared-hinge SVM against the phrases of clean documents
that the last round scored highest, and others, and deals each toxic document to those of its guesses that are found toxic. The machine is
linear in the subsequences, so a fitted model is one small table of weights.

Fitting takes a bounded sample (``Bounds``) of labelled documents, in one task on an executor; the driver gets the
weights only.

Cases: null and empty texts get the score of a text without words; with no toxic or no clean rows to learn from
every score is 0; null labels are left out, of repeated labels the greatest counts; rows that repeat a doc_id count once in fitting
(the least text) and are scored each; extra columns are kept, but for ``toxicity``, which is replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .shared import materialise
from .words import give_back, mix, slices, span_hashes

THRESHOLD, DECAY, ROUNDS, LANDMARKS = 0.7, 0.5, 3, 360


@dataclass(frozen=True)
class Bounds:
    """What a fit uses at most, so that it fits one task whatever the tables hold."""

    #: Labelled rows of each class and the bytes of their texts together: those with the least hash of doc_id.
    toxic_rows: int = 1500
    clean_rows: int = 4500
    toxic_bytes: int = 8 << 20
    clean_bytes: int = 20 << 20
    #: Phrases: first guesses, those of them that are also disguised, clean ones that score highest, other clean ones.
    guesses: int = 4000
    disguised: int = 150
    hard: int = 5000
    others: int = 3000


#: A phrase is a first guess if the rate of toxic documents that hold it is so many times that of clean ones, and
#: the likelihood ratio against equal rates is so many nats.
RATIO, SURPRISE = 4.0, 7.0
#: Steps between the characters of a subsequence, with the weight.
PATTERNS = [(x, DECAY ** (sum(x) - len(x))) for n, most in ((2, 3), (3, 2)) for x in product(range(1, most + 1), repeat=n)]
#: Numbers of subsequences: three characters exactly (6 bits each), four hashed to as many again.
EXACT, HASHED = 1 << 18, 1 << 20
#: Bytes of text read at a time.
SLICE_BYTES = 1 << 19
_MARK = 63


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """kind and symbol of each byte. Kinds: 0 dropped, 1 white space, 2 kept, 3 ends a sentence before white space,
    4 white space that always does."""
    kind, symbol = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    kind[[32, 9, 11, 12]], kind[[10, 13]], kind[[46, 33, 63]] = 1, 4, 3
    kind[128:] = 2
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz2689"):
        for byte in {ord(c), ord(c.upper())}:
            kind[byte], symbol[byte] = 2, i + 1
    for digit, letter in zip("013457", "oieast", strict=True):
        kind[ord(digit)], symbol[ord(digit)] = 2, symbol[ord(letter)]
    kind[ord("@")], symbol[ord("@")], kind[ord("$")], symbol[ord("$")] = 2, symbol[ord("a")], 2, symbol[ord("s")]
    return kind, symbol


_KIND, _SYMBOL = _tables()


@dataclass
class Phrases:
    """Texts as symbols: a mark before each word and after the last. Of each word: its mark, its sentence's last
    word's end, its row."""

    codes: np.ndarray
    marks: np.ndarray
    sentences: np.ndarray
    rows: np.ndarray

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: where the phrase of it alone ends, and the one with the next word of its sentence (or itself)."""
        one = np.append(self.marks[1:], len(self.codes) - 1)
        two = one.copy()
        same = np.flatnonzero(self.sentences[1:] == self.sentences[:-1])
        two[same] = one[same + 1]
        return one, two

    def text(self, word: int, end: int) -> np.ndarray:
        return self.codes[self.marks[word] : end + 1]


def read(texts: pa.Array) -> Iterator[tuple[int, int, Phrases]]:
    """(first row, end row, phrases) of parts of the texts."""
    for first, end, data, offsets in slices(texts, SLICE_BYTES):
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        char = data[lead]
        kind, symbol = _KIND[char], _SYMBOL[char]
        if (wide := np.flatnonzero(char >= 0xC0)).size:
            after = data[np.minimum(lead[wide] + 1, len(data) - 1)].astype(np.int64)
            last = data[np.minimum(lead[wide] + 2, len(data) - 1)].astype(np.int64)
            after[(char[wide] == 0xC3) & (after <= 0x9E)] += 0x20  # upper case
            long = char[wide] >= 0xE0
            symbol[wide] = 31 + (char[wide].astype(np.int64) * 64 + after + np.where(long, last * 7, 0)) % 32
            odd = (char[wide] == 0xC2) | ((char[wide] == 0xE2) & (after <= 0x81)) | ((char[wide] == 0xEF) & (after == 0xBB))
            kind[wide[odd]] = 0  # signs, dashes and characters of no width
            kind[wide[(char[wide] == 0xC2) & (after == 0xA0)]] = 1
        starts = np.searchsorted(lead, offsets[:-1])
        starts = starts[starts < len(lead)]
        space = (kind == 1) | (kind == 4)
        closes = np.append(space[1:], True) if len(space) else space
        closes[starts[starts > 0] - 1] = True
        word, sentence = space.astype(np.int32), ((kind == 4) | ((kind == 3) & closes)).astype(np.int32)
        np.add.at(word, starts, 1)
        np.add.at(sentence, starts, 1)
        kept = np.flatnonzero(kind == 2)
        word, sentence, codes = np.cumsum(word)[kept], np.cumsum(sentence)[kept], symbol[kept]
        change = np.concatenate([[True], (word[1:] != word[:-1]) | (sentence[1:] != sentence[:-1])])[: len(kept)]
        begins = np.flatnonzero(change)
        if len(begins):  # letters written apart: three words and more of one letter in a row
            alone = np.diff(np.append(begins, len(kept))) == 1
            joins = np.concatenate([[False], alone[1:] & alone[:-1] & (sentence[begins[1:]] == sentence[begins[:-1]])])
            joins &= np.append(joins[1:], False) | np.concatenate([[False], joins[:-1]])
            change[begins[joins]] = False
            begins = begins[~joins]
        number = np.cumsum(change)
        out = np.full(len(kept) + len(begins) + 1, _MARK, np.uint8)
        out[np.arange(len(kept)) + number] = codes
        rows = np.searchsorted(offsets, lead[kept[begins]], "right") - 1
        yield first, end, Phrases(out, *(x.astype(np.int32) for x in (begins + np.arange(len(begins)), sentence[begins], rows)))


def run_numbers(codes: np.ndarray) -> Iterator[tuple[np.ndarray, int, float]]:
    """For each pattern: the numbers of the subsequences that begin at each place (those that end past the last are
    left out), their width, the weight."""
    wide = codes.astype(np.uint32)
    for steps, weight in PATTERNS:
        ends = np.cumsum((0, *steps)).tolist()
        many = len(wide) - ends[-1]
        if many <= 0:
            continue
        number = wide[:many]
        for end in ends[1:]:
            number = (number << np.uint32(6)) | wide[end : end + many]
        if len(steps) == 3:
            number = np.uint32(EXACT) + ((number * np.uint32(0x9E3779B1)) >> np.uint32(12))
        yield number, ends[-1], weight


def norms(lengths: np.ndarray) -> np.ndarray:
    """Of phrases of so many symbols, marks included."""
    return np.sqrt(np.maximum(sum(w * w * np.maximum(lengths - sum(x), 0) for x, w in PATTERNS), 1e-9))


def phrase_scores(phrases: Phrases, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted subsequences over the norm: of each word, and of each word with the next."""
    one, two = phrases.ends()
    if not len(one):
        return np.zeros(0), np.zeros(0)
    size = len(phrases.codes)
    many = np.diff(np.append(phrases.marks, size - 1))
    place = np.arange(size - 1)
    left_one, left_two = (np.minimum(np.repeat(end, many) - place, 255).astype(np.uint8) for end in (one, two))
    inner, outer = np.zeros(size - 1, np.float32), np.zeros(size - 1, np.float32)
    for number, width, weight in run_numbers(phrases.codes):
        value = table.take(number, mode="clip")
        value *= np.float32(weight)
        here = slice(0, len(value))
        inner[here] += value * (left_one[here] >= width)
        outer[here] += value * (left_two[here] >= width)
    inner, outer = np.add.reduceat(inner, phrases.marks), np.add.reduceat(outer, phrases.marks)
    paired = np.flatnonzero(two > one)
    outer[paired] += inner[paired + 1]
    return inner / norms(one - phrases.marks + 1), outer / norms(two - phrases.marks + 1)


def _features(phrases: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    """Phrases x known subsequences (sorted numbers), normalised."""
    lengths = np.fromiter(map(len, phrases), np.int64, len(phrases))
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(lengths.sum())
    owner = np.repeat(np.arange(len(phrases)), lengths) * len(known)
    cells, weights = [], []
    for number, width, weight in run_numbers(np.concatenate(phrases)):
        at = np.flatnonzero(left[: len(number)] > width)
        place = np.searchsorted(known, number[at])
        place[place == len(known)] = 0
        hit = known[place] == number[at]
        cells.append(owner[at[hit]] + place[hit])
        weights.append(np.full(len(cells[-1]), weight))
    out = np.bincount(np.concatenate(cells), np.concatenate(weights), len(phrases) * len(known)).reshape(len(phrases), len(known))
    return (out / norms(lengths)[:, None]).astype(np.float32)


@dataclass
class ToxicityModel:
    """Weights of subsequences, bias, and the logistic scale from score to probability."""

    runs: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def table(self) -> np.ndarray:
        table = np.zeros(EXACT + HASHED, np.float32)
        table[self.runs] = self.weights
        return table

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -30, 30)))


def _fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Squared-hinge SVM with balanced classes by Newton steps; cost: of each row within its class. The last
    weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    cost = np.where(y > 0, cost / cost[y > 0].mean() / max((y > 0).sum(), 1), cost / cost[y < 0].mean() / max((y < 0).sum(), 1)) * len(y) / 2
    w = np.zeros(x.shape[1])
    eye = ridge * np.eye(x.shape[1])
    eye[-1, -1] = 1e-3
    for _ in range(20):
        active = y * (x @ w) < 1
        xa = x[active] * cost[active, None]
        new = np.linalg.solve(x[active].T @ xa + eye, xa.T @ y[active])
        if np.allclose(new, w, atol=1e-5):
            break
        w = new
    return w


def _fit_logistic(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling with softened targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y > 0, 0.5 / pos, 0.5 / neg)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * scores + b, -30, 30)))
        g = weight * (p - target)
        h = weight * p * (1 - p) + 1e-9
        gradient = np.array([(g * scores).sum() + 1e-4 * a, g.sum()])
        hessian = np.array([[(h * scores * scores).sum() + 1e-4, (h * scores).sum()], [(h * scores).sum(), h.sum()]])
        step = np.linalg.solve(hessian + 1e-9 * np.eye(2), gradient)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(max(a, 0.1)), float(b)


def _phrase_hashes(part: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, end) of each phrase: the words, then the pairs."""
    one, two = part.ends()
    paired = np.flatnonzero(two > one)
    words, ends = np.concatenate([np.arange(len(one)), paired]), np.concatenate([one, two[paired]])
    return span_hashes(part.codes, part.marks[words], ends + 1), words, ends


def _unlike(parts: list[Phrases], rows: int) -> np.ndarray:
    """Rows with words that are no near copies of earlier ones, which say nothing more: such share two of four least
    hashes of their phrases with the same row."""
    none = np.iinfo(np.uint64).max
    least = np.full((rows, 4), none, np.uint64)
    for part in parts:
        hashes, words, _ = _phrase_hashes(part)
        for k in range(4):
            np.minimum.at(least[:, k], part.rows[words], mix(hashes + np.uint64(k)))
    keep, seen = np.zeros(rows, bool), {}
    for i, own in enumerate(least.tolist()):
        if own[0] != none:
            shared = [j for k, h in enumerate(own) if (j := seen.get((k, h))) is not None]
            keep[i] = len(shared) == len(set(shared))
            if keep[i]:
                seen.update(((k, h), i) for k, h in enumerate(own))
    return keep


def fit(texts: Iterable[str | None], toxic: Iterable[int], bounds: Bounds = Bounds(), seed: int = 7) -> ToxicityModel | None:  # noqa: B008
    """None if either class is absent."""
    texts = pa.array(list(texts), pa.large_string())
    y = np.where(np.array(list(toxic), np.int64) > 0, 1, -1)
    parts = []
    for first, _, part in read(texts):
        part.rows = part.rows + first
        parts.append(part)
    use = _unlike(parts, len(y)) | (y < 0)
    use[list(set(range(len(y))) - {r for p in parts for r in np.unique(p.rows).tolist()})] = False
    pos_rows, neg_rows = (use & (y > 0)).sum(), (use & (y < 0)).sum()
    if not (pos_rows and neg_rows):
        return None
    rng = np.random.default_rng(seed)

    def documents(part: Phrases, hashes: np.ndarray, words: np.ndarray, label: int) -> np.ndarray:
        """The hashes of the part, once for each document of the class."""
        rows = part.rows[words]
        own = use[rows] & (y[rows] == label)
        hashes, rows = hashes[own], rows[own]
        order = np.lexsort((rows, hashes))
        hashes, rows = hashes[order], rows[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        return hashes[fresh]

    hashed = lambda: ((part, *_phrase_hashes(part)) for part in parts)
    held, in_pos = np.unique(np.concatenate([documents(part, h, w, 1) for part, h, w, _ in hashed()]), return_counts=True)
    often = in_pos >= min(2, in_pos.max())
    held, in_pos = held[often], in_pos[often]
    in_neg = np.zeros(len(held))
    for part, h, w, _ in hashed():
        h = documents(part, h, w, -1)
        place = np.searchsorted(held, h).clip(max=len(held) - 1)
        np.add.at(in_neg, place[held[place] == h], 1)
    p, q, both = in_pos / pos_rows, (in_neg + 0.5) / (neg_rows + 1), (in_pos + in_neg) / (pos_rows + neg_rows)
    xlogx = lambda n, r: n * np.log(np.maximum(r, 1e-300))
    chance = xlogx(in_pos, p / both) + xlogx(pos_rows - in_pos, np.maximum(1 - p, 1e-12) / np.maximum(1 - both, 1e-12)) + xlogx(in_neg, in_neg / neg_rows / both) + xlogx(neg_rows - in_neg, (1 - in_neg / neg_rows) / np.maximum(1 - both, 1e-12))
    surprise = np.where(p >= RATIO * q, chance, 0.0)
    if not surprise.any():
        surprise = np.where(p > q, chance, 0.0)
    guess = np.flatnonzero(surprise >= min(SURPRISE, surprise.max()))
    guess = np.sort(guess[np.argsort(-surprise[guess], kind="stable")][: bounds.guesses])
    guesses: list[np.ndarray | None] = [None] * len(guess)
    members = []  # (row, guess) wherever a toxic document holds one
    for part, h, w, e in hashed():
        place = np.searchsorted(held[guess], h).clip(max=len(guess) - 1)
        hit = np.flatnonzero((held[guess][place] == h) & use[part.rows[w]] & (y[part.rows[w]] > 0))
        for i in hit.tolist():
            if guesses[place[i]] is None:
                guesses[place[i]] = part.text(w[i], e[i])
        members.append(np.stack([part.rows[w[hit]], place[hit]]))
    row_of, guess_of = np.concatenate(members, axis=1)
    weight = in_pos[guess].astype(np.float64)
    disguised = [(i, k) for i in np.argsort(-surprise[guess], kind="stable")[: bounds.disguised] for k in range(2, len(guesses[i]) - 1)]
    altered = [np.insert(guesses[i], k, rng.integers(1, 27)).astype(np.uint8) for i, k in disguised]

    table, bias = None, 0.0
    for _ in range(ROUNDS):
        # against the phrases of clean documents that the last round scored highest, and others
        pool: list[tuple[float, np.ndarray]] = []
        others: list[np.ndarray] = []
        share = bounds.others / max(sum(int((y[p.rows] < 0).sum()) for p in parts), 1)
        seen: set[bytes] = set()
        for part in parts:
            one, two = part.ends()
            clean = np.flatnonzero(y[part.rows] < 0)
            for i in clean[rng.random(len(clean)) < share].tolist():
                others.append(part.text(i, one[i] if rng.random() < 0.5 else two[i]))
            if table is not None and len(clean):
                for scores, ends in zip(phrase_scores(part, table), (one, two), strict=True):
                    top = clean[np.argsort(-scores[clean], kind="stable")[: 200 + bounds.hard // len(parts)]]
                    for i in top.tolist():
                        if (key := part.text(i, ends[i]).tobytes()) not in seen:
                            seen.add(key)
                            pool.append((float(scores[i]), part.text(i, ends[i])))
                pool = sorted(pool, key=lambda x: -x[0])[: bounds.hard]
        hard = [codes for _, codes in pool]
        against = hard + others
        if not against:
            return None
        lead = np.argsort(-weight, kind="stable")[: LANDMARKS // 2]
        picked = rng.choice(len(others), min(len(others), LANDMARKS // 4), replace=False) if others else []
        marks = [guesses[i] for i in lead] + hard[: LANDMARKS // 4] + [others[i] for i in picked]
        known = np.unique(np.concatenate([number for codes in marks for number, _, _ in run_numbers(codes)] or [np.zeros(1, np.uint32)]))
        landmark = _features(marks, known).astype(np.float64)
        values, vectors = np.linalg.eigh(landmark @ landmark.T)
        large = values > 1e-6
        nystrom = (landmark.T @ (vectors[:, large] / np.sqrt(values[large]))).astype(np.float32)  # subsequences x dimensions
        del landmark
        chosen = guesses + altered + against
        x = np.vstack([_features(chosen[k : k + 100], known) @ nystrom for k in range(0, len(chosen), 100)]).astype(np.float64)
        bad = len(guesses) + len(altered)
        cost = np.concatenate([weight, [weight[i] / 2 for i, _ in disguised], np.ones(len(against))])
        w = _fit_svm(x, np.concatenate([np.ones(bad), -np.ones(len(against))]), cost)
        weights, bias = (nystrom @ w[:-1]).astype(np.float32), float(w[-1])
        table = ToxicityModel(known, weights, bias, 1.0, 0.0).table()
        # a toxic document counts for those of its guesses that the machine finds toxic, in equal parts; a guess that
        # is no document's counts little
        found = (x[: len(guesses)] @ w[:-1] + bias > 0)[guess_of]
        shares = found / np.maximum(np.bincount(row_of, found, len(y)), 1)[row_of]
        weight = 0.25 + np.bincount(guess_of, shares, len(guesses))
    worst = np.full(len(y), -np.inf)
    for part in parts:
        scores = np.maximum(*phrase_scores(part, table)) + bias
        np.maximum.at(worst, part.rows, scores)
    slope, shift = _fit_logistic(worst[use], y[use])
    return ToxicityModel(known, weights, bias, slope, shift)


def training_rows(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:  # noqa: B008
    """doc_id, text and toxic of labelled documents within the bounds, those with the least hash of doc_id. Texts above a quarter of
    their class's bytes are passed over; of a class that has no others, the shortest is learned from."""
    of = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    of = of.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = of.filter("toxic > 0").orderBy(*order).limit(bounds.toxic_rows).unionByName(of.filter("toxic <= 0").orderBy(*order).limit(bounds.clean_rows))
    # at most so many ids and labels
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("class", (F.col("toxic") > 0).cast("int"))
    # lengths first: only texts within the bounds are read into the one task
    sizes = rows.groupBy("doc_id", "class").agg(F.min(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"))
    most = F.when(F.col("class") > 0, bounds.toxic_bytes).otherwise(bounds.clean_bytes)
    # a long text would take up the bytes of all after it
    sizes = sizes.withColumn("long", F.col("bytes") > most / 4)
    window = Window.partitionBy("class").orderBy("long", F.when(F.col("long"), F.col("bytes")), *order)
    taken = F.when(F.col("long"), F.col("n") == 1).otherwise(F.col("sum") <= most)
    within = sizes.withColumns({"n": F.row_number().over(window), "sum": F.sum("bytes").over(window)}).filter(taken).select("doc_id", F.col("bytes").alias("_bytes"))
    fits = rows.join(F.broadcast(within), "doc_id").filter(F.octet_length(F.coalesce("text", F.lit(""))) == F.col("_bytes"))
    return fits.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def fit_rows(rows: DataFrame, bounds: Bounds = Bounds()) -> ToxicityModel | None:  # noqa: B008
    """fit() in one task over rows within the bounds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            all_rows = pd.concat(parts).sort_values("doc_id")
            yield pd.DataFrame({"model": [pickle.dumps(fit(all_rows["text"], all_rows["toxic"], bounds))]})
            give_back()

    found = materialise(rows.repartition(1).mapInPandas(run, "model binary"), "toxicity-model").collect()
    return pickle.loads(found[0]["model"]) if found else None


def toxicity(model: ToxicityModel | None) -> Column:
    """The score of column text."""
    if model is None:
        return F.lit(0.0)

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = model.table()
        for batch in batches:
            worst = np.full(len(batch), -1.0)  # without words: the least that phrases have
            for first, _, part in read(batch):
                if len(part.rows):
                    np.maximum.at(worst, part.rows + first, np.maximum(*phrase_scores(part, table)))
            yield pa.array(model.probability(worst + model.bias))
        give_back()

    return score(F.col("text"))


def score_toxicity(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """docs with toxicity, from 0 to 1."""
    return docs.withColumn("toxicity", toxicity(model))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold."""
    return docs.filter(toxicity(fit_rows(training_rows(docs, labels))) < threshold)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_toxicity(docs, fit_rows(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))))
    return scored.select(
        "doc_id",
        (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"),
    )
