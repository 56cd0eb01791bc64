"""Connected components of large graphs by alternating star operations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links a-b: each node that isn't the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, x, label[y])
        np.minimum.at(label, y, label[x])
        label = label[label]
        if (label == before).all():
            break
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def connected_components(edges: DataFrame) -> DataFrame:
    """id, component (the least id reachable) of every id that has an edge (a, b).

    Large stars hang each node's greater neighbours on its least one, small stars the lesser ones; after a few
    rounds, about the logarithm of the longest path, every component is one star. Each round is written to the
    shared folder.
    """
    stars = edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    stars = materialise(stars, "stars")
    mark = _mark(stars)
    while mark[0]:
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        stars = materialise(small.unionByName(root.select("hi", F.col("m").alias("lo"))).distinct(), "stars")
        if (new := _mark(stars)) == mark:
            break
        mark = new
    return stars.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(stars.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())


def _mark(stars: DataFrame) -> tuple[int, int]:
    row = stars.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)
