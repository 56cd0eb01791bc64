"""Near-duplicate vectors by cross-polytope hashing with fast Hadamard rotations.

Each of ``tables`` tables rotates the normalised vectors (three rounds of random signs and a Hadamard
transform) once per hash; a hash is the coordinate of greatest size, with its sign. A vector lies in the bucket
of its hashes and looks into the ``probes`` likeliest buckets. Large buckets are cut into blocks, block pairs
are separate groups, and within a group only pairs with cosine >= threshold in double precision count. A pair that
meets in several buckets counts in the first: both vectors' hashes tell which that is. Groups return sums of
links and a spanning forest, never their pairs.

Equal vectors of a label are compared once. The number of hashes follows the logarithm of a label's number of vectors, so that a
label's links don't depend on the others', and the probes grow with it. Of random pairs at cosine 0.93 in 64 dimensions 100 % meet
with 2 hashes and 4 probes, 99.9 % with 3 and 8, 99.7 % with 4 and 16 (tests/llm/test_pairs.py holds 99.5 % of each), more above.

Cases: vectors that are null, zero or hold null or non-finite components, and vectors with a null label, link
with nothing; vectors of different lengths never link; repeated rows count as vectors each, but rows that share
a vec_id and a vector are linked like copies; null ids are their own component (null); an empty table gives an
empty result; extra columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components, forest
from .shared import carried, materialise

THRESHOLD, TABLES, BLOCK, SEED = 0.93, 8, 512, 11


def _rotated(x: np.ndarray, seed: int) -> np.ndarray:
    size = x.shape[1]
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = x * rng.choice([-1.0, 1.0], size)
        h = 1
        while h < size:
            x = x.reshape(len(x), -1, 2, h)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), -1)
            h *= 2
        x = x / math.sqrt(size)
    return x


class CrossPolytope:
    """Codes of the buckets that unit vectors look into: vectors x tables x probes, the own bucket first."""

    def __init__(self, hashes: int, tables: int = TABLES, probes: int | None = None, seed: int = SEED) -> None:
        self.hashes, self.tables, self.probes, self.seed = hashes, tables, probes or 4 << max(0, hashes - 2), seed
        self.choices = np.array(list(product(range(min(self.probes, 6)), repeat=hashes)))

    def codes(self, unit: np.ndarray) -> np.ndarray:
        size = 1 << max(1, (unit.shape[1] - 1).bit_length())
        unit = np.pad(unit, ((0, 0), (0, size - unit.shape[1])))
        wide = min(min(self.probes, 6), size)
        choices = self.choices[(self.choices < wide).all(axis=1)]
        out = np.full((len(unit), self.tables, self.probes), -1, np.int64)
        rows = np.arange(len(unit))[:, None]
        for t in range(self.tables):
            corners, cost = [], 0
            for j in range(self.hashes):
                y = _rotated(unit, self.seed * 1_000_003 + t * 1009 + j)
                best = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :wide]
                value = y[rows, best]
                corners.append(best * 2 + (value < 0))
                lost = (np.abs(value[:, :1]) - np.abs(value)) ** 2
                cost = cost + lost[:, choices[:, j]]
            order = np.argsort(cost, axis=1, kind="stable")[:, : self.probes]
            code = 0
            for j in range(self.hashes):
                code = code * (2 * size) + corners[j][rows, choices[order, j]]
            out[:, t, : order.shape[1]] = code
        return out


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1)[:, None]


def _links(ids, counts, unit, table, query, index, hasher, threshold) -> tuple[np.ndarray, ...]:
    """Of candidate pairs query-index (row numbers): (rows, sums of links), forest."""
    hit = np.einsum("ij,ij->i", unit[query], unit[index]) >= threshold
    query, index = query[hit], index[hit]
    if not len(query):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, at = np.unique(np.concatenate([query, index]), return_inverse=True)
    codes = hasher.codes(unit[rows])
    x, y = codes[at[: len(query)]], codes[at[len(query) :]]
    meets = np.stack([(x == y[:, :, :1]).any(axis=2), (y == x[:, :, :1]).any(axis=2)], axis=2)  # query looks, index looks
    swap = ids[query] > ids[index]
    meets[swap] = meets[swap][:, :, ::-1]
    first = meets.reshape(len(query), -1).argmax(axis=1)
    here = first == 2 * table[query] + swap
    query, index = query[here], index[here]
    who = np.concatenate([ids[query], ids[index]])
    many = np.concatenate([counts[index], counts[query]])
    nodes, where = np.unique(who, return_inverse=True)
    return nodes, np.bincount(where, many, len(nodes)).astype(np.int64), *forest(ids[query], ids[index])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """vectors with n_links, component_id and kept."""
    vectors = vectors.drop("n_links", "component_id", "kept")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    good = vectors.filter(usable).select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    same = materialise(good.groupBy("label", "v").agg(F.min("vec_id").cast("long").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")
    counted = same.groupBy("label", F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    # only labels with more vectors than two hashes have buckets: one for each that many vectors
    needed = F.ceil(F.log(F.col("n")) / F.log(2.0 * F.col("dim")) - 1e-9).cast("int")
    large = counted.select(F.col("label").alias("of"), "dim", needed.alias("hashes")).filter("hashes > 2")
    same = same.join(large, (F.col("label") == F.col("of")) & (F.size("v") == F.col("dim")), "left").select("label", "v", "rep", "copies", F.coalesce("hashes", F.lit(2)).alias("hashes"))
    hashers: dict[int, CrossPolytope] = {}

    def hasher_of(hashes: int) -> CrossPolytope:
        if hashes not in hashers:
            hashers[hashes] = CrossPolytope(hashes, tables)
        return hashers[hashes]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (dim, hashes), part in batch.groupby([batch["v"].map(len), batch["hashes"]]):
                codes = hasher_of(hashes).codes(_unit(part["v"]))
                n, _, probes = codes.shape
                frame = pd.DataFrame({
                    "rep": np.repeat(part["rep"].to_numpy(), tables * probes),
                    "label": np.repeat(part["label"].astype(str).to_numpy(), tables * probes),
                    "dim": dim,
                    "tbl": np.tile(np.repeat(np.arange(tables), probes), n),
                    "code": codes.ravel(),
                    "own": np.tile(np.arange(probes) == 0, n * tables),
                })
                yield frame[frame["code"] >= 0]

    looks = same.select("rep", "label", "v", "hashes").mapInPandas(look, "rep long, label string, dim int, tbl int, code long, own boolean")
    looks = materialise(looks.withColumn("bucket", F.xxhash64("label", "dim", "tbl", "code")).select("bucket", "tbl", "rep", "own"), "looks")
    sizes = looks.groupBy("bucket").agg(F.sum(F.col("own").cast("long")).alias("owners"), F.count(F.lit(1)).alias("lookers")).filter("owners > 0 AND lookers > 1")
    chunks = lambda c: F.ceil(F.col(c) / F.lit(block)).cast("int")
    spread = looks.join(sizes, "bucket").withColumns({"ni": chunks("owners"), "nq": chunks("lookers")})
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = spread.select("bucket", "tbl", "rep", F.lit(False).alias("own"), part("nq").alias("q"), every("ni").alias("i")).unionByName(
        spread.filter("own").select("bucket", "tbl", "rep", F.lit(True).alias("own"), every("nq").alias("q"), part("ni").alias("i"))
    )
    loaded = members.join(same.select("rep", "copies", "v", "hashes"), "rep").withColumn("key", F.xxhash64("bucket", "q", "i"))
    loaded = loaded.repartition("key").sortWithinPartitions("key", "bucket", "q", "i")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _whole_groups(batches):
            group = batch["group"].to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            ids, counts, table, own = (batch[c].to_numpy() for c in ("rep", "copies", "tbl", "own"))
            kinds = pd.Series(list(zip(batch["v"].map(len), batch["hashes"], strict=True)))
            for kind in kinds.unique():
                (dim, hashes), of = kind, np.flatnonzero(kinds == kind)
                unit, hasher = np.zeros((len(batch), dim)), hasher_of(hashes)
                unit[of] = _unit(batch["v"].iloc[of])
                pairs, size = [], 0
                for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                    if kinds.iloc[low] != kind:
                        continue
                    index, query = low + np.flatnonzero(own[low:high]), low + np.flatnonzero(~own[low:high])
                    near = np.argwhere(unit[query] @ unit[index].T >= threshold - 1e-9)
                    near = near[ids[query[near[:, 0]]] != ids[index[near[:, 1]]]]
                    if len(near):
                        pairs.append((query[near[:, 0]], index[near[:, 1]]))
                        size += len(near)
                    if size > 200_000:
                        yield from _found(pairs, ids, counts, unit, table, hasher, threshold)
                        pairs, size = [], 0
                if pairs:
                    yield from _found(pairs, ids, counts, unit, table, hasher, threshold)

    found = materialise(loaded.mapInPandas(verify, "a long, b long, links long"), "links")
    degrees = found.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("_degree"))
    parts = connected_components(found.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("id", "rep")
    known = same.join(degrees, "rep", "left").join(parts, "rep", "left").select(
        F.col("label").alias("of"), "v", (F.coalesce("_degree", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component")
    )
    keyed = vectors.select(carried(vectors), "vec_id", "label", F.when(usable, F.transform("embedding", lambda x: x.cast("double"))).alias("w"))
    out = keyed.join(known, (F.col("label") == F.col("of")) & (F.col("w") == F.col("v")), "left")
    component = F.coalesce(F.col("component"), F.col("vec_id").cast("long"))
    out = out.select("row", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
    return out.select("row.*", "n_links", "component_id", "kept")


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of sorted rows, cut where the group changes, with the group numbered."""
    held = None
    for batch in batches:
        batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
        keys = batch[["key", "bucket", "q", "i"]].to_numpy()
        last = len(batch) - int(np.argmax(np.append((keys[::-1] != keys[-1]).any(axis=1), True)))
        held = batch.iloc[last:]
        if last:
            yield _numbered(batch.iloc[:last].reset_index(drop=True))
    if held is not None and len(held):
        yield _numbered(held.reset_index(drop=True))


def _numbered(batch: pd.DataFrame) -> pd.DataFrame:
    keys = batch[["key", "bucket", "q", "i"]].to_numpy()
    return batch.assign(group=np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))]))


def _found(pairs, ids, counts, unit, table, hasher, threshold) -> Iterator[pd.DataFrame]:
    query, index = (np.concatenate(x) for x in zip(*pairs, strict=True))
    nodes, links, a, b = _links(ids, counts, unit, table, query, index, hasher, threshold)
    if len(nodes):
        yield pd.DataFrame({"a": nodes, "b": pd.array([pd.NA] * len(nodes), "Int64"), "links": links})
    if len(a):
        yield pd.DataFrame({"a": a, "b": pd.array(b, "Int64"), "links": 0})


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    return near_duplicates(vectors).select("vec_id", "n_links", "component_id", "kept")


OP8_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS i, b.vec_id AS j FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.93),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.j, r.c FROM r JOIN l ON l.i = r.vec_id),
n AS (SELECT i AS vec_id, count(*) AS n FROM l GROUP BY i)
SELECT vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(c)::BIGINT AS component_id, vec_id = min(c) AS kept FROM r LEFT JOIN n USING (vec_id) GROUP BY vec_id
"""
