"""What several corpus operators need: the shared folder, materialised steps and salted ranks."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that every contract of this subpackage names: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts that a group of rows with one rank key is split into.
SALTS = 256


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share. Where the setting is absent, a local
    session gets a folder of its own machine; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session's settings for what runs inside."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor
    costs no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def carried(df: DataFrame) -> Column:
    """All columns of df as one, ``row``: what is computed beside it can't clash with their names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` equals that for pure ASCII and is much faster there."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def salted_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], salt: Column, rank: str) -> DataFrame:
    """Zero-based rank of each row among the rows with its keys, in the order of (salt, order).

    No key's rows meet in one task: they're ranked within (keys, salt), and the counts of at most SALTS
    salts give each salt's first rank.
    """
    salted = df.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int"))
    counts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    ranked = salted.withColumn("_within", F.row_number().over(within) - 1)
    return (
        ranked.join(offsets, [*keys, "_salt"])
        .withColumn(rank, (F.col("_before") + F.col("_within")).cast("long"))
        .drop("_salt", "_within", "_before")
    )
