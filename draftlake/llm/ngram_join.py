"""Jaccard similarity join on word shingles, filtered under several global orders of the shingles.

Any global order gives a prefix filter: two sets that are similar enough share some of their first elements.
Three orders are intersected before a pair is verified:

- by hash: each document keeps its first ``p(n)`` shingles in this order, so many that two similar documents
  must share at least ``l`` of them (an extended prefix), not just one;
- rarest first, among those kept: frequencies are counted over all documents, and shingles that no other
  document keeps come first and are never looked up. Documents that share a place in this prefix meet;
- by another hash, among those kept.

Equal sets are one class, numbered, and compared once. Where classes meet, each is first compared with up to four
pivots (the least, the greatest, a random one and the most central one: a base text, whose shingles its edited
copies share, while they have some of their own) and joined in components; places that still hold several components
give new pivots, and those that hold several even then are compared in full, in blocks. Whole sets lie in memory-mapped
files of the shared folder, so that pairs are verified where they are found; a block returns a forest of its links, never its pairs. So no
group of copies is expanded into its pairs, and no link between components is lost. Verification compares whole
sets exactly, as 64-bit hashes of the shingles.

Cases: documents without words have an empty set and link with nothing; with fewer words than a shingle's the
whole sequence is the one shingle; a null text has no words; rows that share a doc_id are one document, with the
links of all its texts; null ids link with nothing (component null); an empty table gives an empty result; of other
columns nothing is read or returned by ``link_documents``, and ``keep_one_each`` returns all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import connected_components, forest
from .elias_fano import map_arrays, write_arrays
from .shared import materialise, shared_dir
from .words import give_back, mix, slices, word_hashes

WORDS, PERCENT, BLOCK = 3, 90, 256
#: Cells of a grid of sets by elements.
GRID_CELLS = 4 << 20
#: Times that new pivots are compared before what is still apart is compared in full; seed of the blocks' spread.
PIVOT_ROUNDS, SEED = 1, 5
#: Rows whose sets a task holds at once.
ROWS_TOGETHER = 1000
#: Sets and ids kept in one file of the shared folder, about.
SETS_OF_FILE, IDS_OF_FILE = 2000, 1_000_000
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def least_overlap(n, percent: int):
    """Fewest elements that a set of n shares with any set it links with."""
    return -(-percent * n // 100)


def extra(n):
    """l(n): elements that similar documents share within their kept prefixes; grows with n."""
    return n // 20 + 1


def kept_size(n, percent: int):
    """p(n): size of the kept prefix."""
    return n - least_overlap(n, percent) + extra(least_overlap(n, percent))


def prefix_size(n, percent: int):
    """Prefix of the kept elements, in any order, within which similar documents share one.

    A partner has at least m = least_overlap(n) elements, so the two share at least extra(least_overlap(m)) of
    those kept.
    """
    sure = extra(least_overlap(least_overlap(n, percent), percent))
    return kept_size(n, percent) - sure + 1


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for _, _, data, offsets in slices(texts):
        hashes, counts = word_hashes(data, offsets)
        ends = np.cumsum(counts)
        run = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
        for j in range(words):
            run = mix(run * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(hashes) - words + 1 + j])
        for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
            if count >= words:
                yield np.unique(run[end - count : end - words + 1])
            elif count:
                one = np.zeros(1, np.uint64)
                for h in hashes[end - count : end]:
                    one = mix(one * np.uint64(0x9E3779B97F4A7C15) + h)
                yield one + np.uint64(count)
            else:
                yield np.zeros(0, np.uint64)


def _hashes(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set."""
    return int(np.add.reduce(mix(s + np.uint64(1))).view(np.int64)), int(np.bitwise_xor.reduce(mix(s ^ _SECOND)).view(np.int64))


def _profiles(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, two hashes of the set, and the kept prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, kept, lengths = [], [], [], [], []
            for s in shingle_sets(batch.column(1), words):
                n.append(len(s))
                first, second = _hashes(s)
                one.append(first)
                two.append(second)
                kept.append(s[: kept_size(len(s), percent)] if len(s) else s)
                lengths.append(len(kept[-1]))
            flat = np.concatenate(kept).view(np.int64) if kept else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), lists], names=["doc_id", "n", "one", "two", "kept"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, one long, two long, kept array<long>")


class SetStore:
    """Whole shingle sets in memory-mapped files of the shared folder, found by their class's number."""

    def __init__(self, folder: str, files: int) -> None:
        self.folder, self.files, self.open = folder, files, {}

    def get(self, numbers: np.ndarray, kind: str = "sets") -> list[np.ndarray]:
        """The sorted set of each class, or the tokens that it looks up."""
        out: list = [None] * len(numbers)
        owner = _owners(numbers, self.files)
        for f in np.unique(owner).tolist():
            if (kind, f) not in self.open:
                self.open[kind, f] = map_arrays(f"{self.folder}/{kind}-{f}")
            a = self.open[kind, f]
            at = np.flatnonzero(owner == f)
            for i, k in zip(at.tolist(), np.searchsorted(a["numbers"], numbers[at]).tolist(), strict=True):
                out[i] = a["data"][a["offsets"][k] : a["offsets"][k + 1]]
        return out


def _owners(numbers: np.ndarray, files: int) -> np.ndarray:
    return (mix(numbers.astype(np.int64).view(np.uint64)) % np.uint64(files)).astype(np.int64)


def _store_sets(docs: DataFrame, met: DataFrame, words: int) -> SetStore:
    """Write the sets of the classes in met (number, doc, the hashes of the set, index: the tokens that it looks up),
    about SETS_OF_FILE to a file.

    The ids in met lie in mapped files too, so that texts are picked where they are read and never shuffled.
    """
    met = materialise(met, "met")
    many = met.count()
    folder = shared_dir(docs.sparkSession, "sets")
    store, id_files = SetStore(folder, 1 + many // SETS_OF_FILE), 1 + many // IDS_OF_FILE

    def write_ids(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc", "number"])
        write_arrays(f"{folder}/ids-{rows['file'].iloc[0]}", {c: rows[c].to_numpy().astype(np.int64) for c in ("doc", "number", "one", "two")})
        return rows.iloc[:1][["file"]]

    spread = F.pandas_udf(lambda d: pd.Series(_owners(d.to_numpy(), id_files)), "long")
    met.select("doc", "number", "one", "two", spread("doc").alias("file")).groupBy("file").applyInPandas(write_ids, "file long").count()
    spread_sets = F.pandas_udf(lambda d: pd.Series(_owners(d.to_numpy(), store.files)), "long")

    def write_lists(rows: pd.DataFrame, kind: str, column: str, of) -> pd.DataFrame:
        rows = rows.drop_duplicates("number").sort_values("number")
        lists = [of(x) for x in rows[column]]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        write_arrays(f"{folder}/{kind}-{rows['file'].iloc[0]}", {"numbers": rows["number"].to_numpy().astype(np.int64), "offsets": offsets, "data": np.concatenate(lists)})
        give_back()
        return rows.iloc[:1][["file"]]

    index = met.select("number", "index", spread_sets("number").alias("file")).groupBy("file")
    index.applyInPandas(lambda rows: write_lists(rows, "index", "index", lambda x: np.asarray(x, np.int64)), "file long").count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[int, dict[str, np.ndarray]] = {}
        for batch in (part.slice(at, ROWS_TOGETHER) for part in batches for at in range(0, part.num_rows, ROWS_TOGETHER)):
            batch = batch.filter(pc.is_valid(batch.column(0)))
            doc = batch.column(0).to_numpy()
            owner = _owners(doc, id_files)
            wanted: dict[int, dict[tuple[int, int], int]] = {}  # row: number of each set that its id stands for
            for f in np.unique(owner).tolist():
                if f not in ids:
                    ids[f] = _mapped_ids(folder, f)
                a, at = ids[f], np.flatnonzero(owner == f)
                low, high = (np.searchsorted(a["doc"], doc[at], side) for side in ("left", "right"))
                for i, l, h in zip(*(x[high > low].tolist() for x in (at, low, high)), strict=True):
                    wanted[i] = {(int(a["one"][k]), int(a["two"][k])): int(a["number"][k]) for k in range(l, h)}
            rows = sorted(wanted)
            part = batch.take(pa.array(rows, pa.int64()))
            sets = list(shingle_sets(part.column(1), words))
            mine = [(n, s.tobytes()) for r, s in zip(rows, sets, strict=True) if (n := wanted[r].get(_hashes(s))) is not None]
            number = np.array([n for n, _ in mine], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(_owners(number, store.files), pa.int64()), pa.array([s for _, s in mine], pa.binary())], names=["number", "file", "set"])
        give_back()

    if many:
        sets = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").mapInArrow(run, "number long, file long, set binary").groupBy("file")
        sets.applyInPandas(lambda rows: write_lists(rows, "sets", "set", lambda x: np.frombuffer(x, np.uint64)), "file long").count()
    return store


def _mapped_ids(folder: str, file: int) -> dict[str, np.ndarray]:
    """The ids of a file; a file that no id fell to isn't there."""
    try:
        return map_arrays(f"{folder}/ids-{file}")
    except FileNotFoundError:
        return {c: np.zeros(0, np.int64) for c in ("doc", "number", "one", "two")}


def _shared_counts(lists: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the lists share. Elements are taken in ranges of values, so that no grid of lists
    by elements has more than about GRID_CELLS cells, however long the lists are."""
    parts = max(1, -(-sum(map(len, lists)) * len(lists) // (2 * GRID_CELLS)))
    lists = [np.sort(x) for x in lists] if parts > 1 else lists
    longest = max(lists, key=len)
    bounds = longest[np.arange(1, parts) * len(longest) // parts] if parts > 1 else longest[:0]
    cuts = [np.concatenate([[0], np.searchsorted(x, bounds), [len(x)]]) for x in lists] if parts > 1 else [[0, len(x)] for x in lists]
    return sum(_grid_counts([x[c[i] : c[i + 1]] for x, c in zip(lists, cuts, strict=True)]) for i in range(parts))


def _grid_counts(lists: list[np.ndarray]) -> np.ndarray:
    owner = np.repeat(np.arange(len(lists)), np.fromiter(map(len, lists), np.int64, len(lists)))
    values, place = np.unique(np.concatenate(lists), return_inverse=True)
    often = np.bincount(place, minlength=len(values)) > 1
    held = often[place]
    grid = np.zeros((len(lists), int(often.sum())), np.float32)
    grid[owner[held], (np.cumsum(often) - 1)[place[held]]] = 1
    return grid @ grid.T


def _linked(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs (positions in sets) link: the orders' filters in turn, then the whole sets."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    low, high = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
    good = 100 * low >= percent * high
    if not good.any():
        return good
    used = np.unique(np.concatenate([x[good], y[good]]))
    kept = {i: sets[i][: kept_size(int(n[i]), percent)] for i in used.tolist()}
    second = {i: k[np.argsort(mix(k ^ _SECOND), kind="stable")[: prefix_size(int(n[i]), percent)]] for i, k in kept.items()}
    many = len(x) > 20 * len(used)
    if many:  # all at once
        number = np.zeros(len(sets), np.int64)
        number[used] = np.arange(len(used))
        first = _shared_counts([kept[i] for i in used.tolist()])
        other = _shared_counts([second[i] for i in used.tolist()])
        good &= (first[number[x], number[y]] >= extra(least_overlap(low, percent))) & (other[number[x], number[y]] > 0)
        at = np.flatnonzero(good)
        if len(at):
            left, where = np.unique(np.concatenate([x[at], y[at]]), return_inverse=True)
            both = _shared_counts([sets[i] for i in left.tolist()])[where[: len(at)], where[len(at) :]]
            good[at] = 100 * both >= percent * (n[x[at]] + n[y[at]] - both)
        return good
    for k in np.flatnonzero(good).tolist():
        i, j = int(x[k]), int(y[k])
        good[k] = (
            np.intersect1d(second[i], second[j], assume_unique=True).size > 0
            and np.intersect1d(kept[i], kept[j], assume_unique=True).size >= extra(least_overlap(int(low[k]), percent))
            and 100 * (both := np.intersect1d(sets[i], sets[j], assume_unique=True).size) >= percent * (n[i] + n[j] - both)
        )
    return good


def _pivot_links(pairs: DataFrame, store: SetStore, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                docs, where = np.unique(part.to_numpy(), return_inverse=True)
                where = where.reshape(-1, 2)
                yield part[_linked(store.get(docs), where[:, 0], where[:, 1], percent)]
        give_back()

    return pairs.select("a", "b").mapInPandas(run, "a long, b long")


def _mixed(places: DataFrame, parts: DataFrame) -> DataFrame:
    """places (token, doc, central) with component, as far as a place still holds several components."""
    labelled = places.join(parts.select(F.col("id").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    several = labelled.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("m")).filter("c0 <> c1 AND m > 3")
    return labelled.join(several.select("token", "m"), "token")


def _next_pivots(mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) of a place's documents with its most central document, and with the most central one of another
    component, where they're of different components."""
    best = F.struct("central", F.xxhash64("doc"), "doc", "component")
    by_part = mixed.groupBy("token", "component").agg(F.max(best).alias("p"), F.count(F.lit(1)).alias("n"))
    # the components with the most documents of the place
    tops = by_part.groupBy("token").agg(F.max(F.struct("n", "p")).alias("first"), F.min(F.struct("n", "p")).alias("last"))
    met = mixed.join(tops.select("token", F.array("first.p", "last.p").alias("pivots")), "token")
    met = met.select("doc", "component", F.explode("pivots").alias("p")).filter("component <> p.component")
    return met.select(F.least("doc", "p.doc").alias("a"), F.greatest("doc", "p.doc").alias("b")).distinct()


def _block_links(mixed: DataFrame, store: SetStore, percent: int, block: int) -> DataFrame:
    """Links between different components among the documents that meet in places (token, doc, component, m), as
    forests.

    The documents of a place are dealt into chunks of about block, and chunks meet in pairs: a row is two chunks, as
    arrays of numbers. A pair counts where it first meets: it's left to a lesser token that both look up.
    """
    chunks = (
        mixed.withColumn("k", F.ceil(F.col("m") / block).cast("int")).withColumn("mine", F.pmod(F.xxhash64("doc"), F.col("k")).cast("int"))
        .groupBy("token", "k", "mine").agg(F.collect_list(F.struct("doc", "component")).alias("docs"))
    )
    # chunk pair (i, j), i <= j: chunk c is in the pairs (c, j) and (i, c)
    met = chunks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    met = met.select("token", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") <= F.col("other"), F.col("docs")).alias("l"), F.when(F.col("mine") >= F.col("other"), F.col("docs")).alias("r"))
    pairs = met.groupBy("token", "i", "j").agg(F.first("l", ignorenulls=True).alias("l"), F.first("r", ignorenulls=True).alias("r"))
    pairs = pairs.filter("l IS NOT NULL AND r IS NOT NULL").select("token", F.col("l.doc").alias("ld"), F.col("l.component").alias("lc"), F.col("r.doc").alias("rd"), F.col("r.component").alias("rc"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [x for x in (compare(*row) for row in batch.itertuples(index=False, name=None)) if len(x[0])]
            if found:
                a, b = forest(*(np.concatenate(x) for x in zip(*found, strict=True)))
                yield pd.DataFrame({"a": a, "b": b})
        give_back()

    def compare(token: int, ld: np.ndarray, lc: np.ndarray, rd: np.ndarray, rc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        docs, at = np.unique(np.concatenate([ld, rd]), return_inverse=True)
        sets, index = store.get(docs), store.get(docs, "index")
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        x, y = at[: len(ld)], at[len(ld) :]
        ok = (lc[:, None] != rc[None, :]) & (100 * np.minimum(n[x][:, None], n[y][None, :]) >= percent * np.maximum(n[x][:, None], n[y][None, :]))
        i, j = np.nonzero(ok)
        pair = np.unique(np.minimum(x[i], y[j]) * len(docs) + np.maximum(x[i], y[j]))
        x, y = pair // len(docs), pair % len(docs)
        if len(x):  # but for those that meet at a lesser token too
            used, where = np.unique(np.concatenate([x, y]), return_inverse=True)
            first = _shared_counts([index[u][index[u] < token] for u in used.tolist()])[where[: len(x)], where[len(x) :]] == 0
            x, y = x[first], y[first]
        good = _linked(sets, x, y, percent) if len(x) else np.zeros(0, bool)
        return forest(docs[x[good]], docs[y[good]]) if good.any() else (x[:0], y[:0])

    return pairs.repartition(F.rand(SEED)).mapInPandas(run, "a long, b long")


def _classes(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sets, numbered: (number, n, one, two, doc: least id); and (id_, number) of the rows with one.

    A class is a vertex of its own, whatever ids its rows have.
    """
    whole = ["n", "one", "two"]
    classes = profiles.filter("n > 0 AND doc_id IS NOT NULL").groupBy(*whole).agg(F.min("doc_id").cast("long").alias("doc"))
    classes = materialise(classes.withColumn("number", F.monotonically_increasing_id()), "classes")
    return classes, materialise(profiles.join(classes.select("number", *whole), whole, "left").select("doc_id", "n", "number"), "members")


def link_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs."""
    profiles = materialise(_profiles(docs, words, percent), "shingles")
    whole = ["n", "one", "two"]
    classes, members = _classes(profiles)
    # the row that stands for a class
    reps = profiles.select(F.col("doc_id").cast("long").alias("doc"), *whole, "kept").join(classes, ["doc", *whole]).dropDuplicates(["number"])
    # how many representatives keep a shingle; what only one keeps can't be shared
    tokens = reps.select("number", F.explode("kept").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    tokens = tokens.join(often, "token")
    ranked = tokens.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked")).join(classes, "number")
    alone = _of_n(kept_size, percent) - F.size("ranked")
    # a base text has no shingles of its own, its edited copies have: it meets more documents in the mean
    central = F.aggregate("ranked", F.lit(0.0), lambda total, r: total + F.log(r["df"].cast("double"))) / _of_n(kept_size, percent)
    kept = materialise(
        ranked.withColumn("look", _of_n(prefix_size, percent) - alone).filter("look > 0").select(
            F.col("number").alias("doc"), central.alias("central"), F.transform(F.slice("ranked", F.lit(1), F.col("look").cast("int")), lambda r: r["token"]).alias("index"),
        ),
        "kept",
    )
    looked = kept.select("doc", "central", F.explode("index").alias("token"))
    pick = [F.min("doc").alias("low"), F.max("doc").alias("high"), F.max(F.struct("central", "doc")).alias("top"), F.min_by("doc", F.xxhash64("doc")).alias("mid")]
    pivots = looked.groupBy("token").agg(*pick).filter("low <> high").select("token", "low", "high", F.col("top.doc").alias("top"), "mid")
    places = materialise(looked.join(pivots, "token"), "places")
    pairs = places.select("doc", F.explode(F.array_distinct(F.array("top", "low", "mid", "high"))).alias("pivot")).filter("doc <> pivot")
    pairs = pairs.select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b")).distinct()
    met = kept.join(places.select("doc"), "doc", "left_semi").select(F.col("doc").alias("number"), "index").join(classes, "number")
    store = _store_sets(docs, met, words)
    parts = materialise(connected_components(_pivot_links(pairs, store, percent)), "parts")
    places = places.select("token", "doc", "central")
    for _ in range(PIVOT_ROUNDS):
        more = materialise(_pivot_links(_next_pivots(_mixed(places, parts)), store, percent), "links-more")
        if more.isEmpty():
            break
        parts = materialise(connected_components(_edges(parts).unionByName(more)), "parts")
    rest = materialise(_block_links(_mixed(places, parts), store, percent, block), "links-rest")
    # rows that share an id are one document, whatever their sets
    by_id = members.filter("number IS NOT NULL").groupBy("doc_id").agg(F.min("number").alias("a"), F.collect_set("number").alias("b")).filter("size(b) > 1")
    by_id = materialise(by_id.select("a", F.explode("b").alias("b")), "links-ids")
    if not (rest.isEmpty() and by_id.isEmpty()):
        parts = materialise(connected_components(_edges(parts).unionByName(rest).unionByName(by_id)), "parts")
    labelled = classes.select("number", "doc").join(parts.withColumnRenamed("id", "number"), "number", "left").withColumn("component", F.coalesce("component", "number"))
    least = labelled.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = labelled.join(least, "component").select("number", "component_id")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", F.col("doc_id").cast("long")))
    return members.join(named, "number", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def _edges(parts: DataFrame) -> DataFrame:
    return parts.select(F.col("id").alias("a"), F.col("component").alias("b"))


def keep_one_each(docs: DataFrame, **options) -> DataFrame:
    """One document of each component: the one whose doc_id names it, and every document without an id."""
    parts = link_documents(docs, **options)
    gone = parts.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def _of_n(size, percent: int) -> Column:
    """least_overlap, kept_size or prefix_size of the column n."""
    n = F.col("n")
    least = lambda m: F.floor((percent * m + 99) / 100)
    more = lambda m: F.floor(m / 20) + 1
    kept = n - least(n) + more(least(n))
    return kept if size is kept_size else kept - more(least(least(n))) + 1


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
         ELSE list_distinct([t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] FOR i IN range(1, len(t) - 1)]) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (
  SELECT a.doc_id AS i, b.doc_id AS j, a.n AS ni, b.n AS nj, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY ALL HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS (SELECT i, j FROM p UNION ALL SELECT j, i FROM p),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.j, r.c FROM r JOIN l ON l.i = r.doc_id)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, min(r.c) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, g
"""
