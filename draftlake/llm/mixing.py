"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source size`` copies. Laid end to end in the source's order,
these expectations make a line; a copy is emitted for each integer that the line crosses after it is shifted
by one random offset. The order is by size, so that neighbours on the line weigh about the same and the words
taken stay within about one document of the target.

Cases: a null text has size 0; a null source is a source of its own, weighed last; a source of size 0 has
target 0; repeated rows count each; an empty table gives an empty result; extra columns are carried along, but for those that the result has itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import carried, salted_rank

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row per source of sizes(_key, _source, _size): source_size and target.

    Water filling in closed form: targets are ``least(most * size, level * weight)``. In order of size per
    weight, the first source that the level of all not yet capped leaves uncapped fixes the level; after it the
    levels only fall, so it has the greatest that leaves its source uncapped. Works on
    one row per source.
    """
    totals = sizes.groupBy("_key", "_source").agg(F.sum("_size").alias("source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_i") - 1, F.lit(len(weights))) + 1).cast("int"))
    by_cap = Window.orderBy("_ratio", "_key")
    earlier, onward = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        totals.withColumn("_i", F.row_number().over(Window.orderBy("_key")))
        .withColumn("_w", weight)
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_ratio", most * F.col("source_size") / F.col("_w"))
        .withColumn("_level", (F.col("_total") - most * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))) / F.sum("_w").over(onward))
        .withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything))
        .select("_key", "source_size", F.least((most * F.col("source_size")).cast("double"), F.col("_level") * F.col("_w")).alias("target"))
    )


def mix_counts(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes the row).

    The offset of a source is a hash of its name and the seed, so reruns agree.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    sized = docs.select(
        carried(docs), "doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_size"), F.col("source").alias("_source"),
        # "0" before a name and "1" for null: sorts by code point with null last
        F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source"))).alias("_key"),
    )
    targets = source_targets(sized.select("_key", "_source", "_size"), weights, most)
    # first rank of each (source, size): sums over the histogram of sizes, not over documents
    histogram = sized.groupBy("_key", "_size").agg(F.count(F.lit(1)).alias("_n"))
    larger = Window.partitionBy("_key").orderBy(F.desc("_size")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = histogram.select("_key", "_size", F.coalesce(F.sum("_n").over(larger), F.lit(0)).alias("_first"))
    ranked = salted_rank(sized, ["_key", "_size"], [F.col("doc_id")], F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_rank")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("_key"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rank = F.col("_first") + F.col("_rank")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        ranked.join(firsts, ["_key", "_size"])
        .join(targets, "_key")
        .withColumn("copies", (F.floor((rank + 1) * rate + offset) - F.floor(rank * rate + offset)).cast("long"))
        .select("row.*", F.col("_size").alias("size"), "source_size", "target", "copies")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mix takes it, numbered by copy_no from 0, with the
    columns of mix_counts."""
    counted = mix_counts(docs.drop("copy_no"), **options).filter("copies > 0")
    return counted.withColumn("copy_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    counted = mix_counts(docs)
    return counted.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
totals AS (SELECT k, sum(size)::BIGINT AS source_size FROM sized GROUP BY k),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::DOUBLE AS w, sum(source_size) OVER () AS total FROM totals),
ratios AS (SELECT *, 3 * source_size / w AS ratio FROM weighed),
levels AS (
  SELECT *, (total - 3 * coalesce(sum(source_size) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(w) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ratios),
targets AS (
  SELECT k, source_size, least((3 * source_size)::DOUBLE, (SELECT max(level) FROM levels WHERE level <= ratio) * w) AS target,
         ('0x' || substr(md5('mix' || k), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM levels),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY size DESC, ((doc_id % 256) + 256) % 256, doc_id) - 1 AS r FROM sized),
copied AS (
  SELECT doc_id, size, source_size, target,
         (floor((r + 1) * (CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) + u)
          - floor(r * (CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) + u))::BIGINT AS copies
  FROM ranked JOIN targets USING (k))
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM copied
"""
