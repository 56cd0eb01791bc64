"""Batch stages that do only what has changed.

A stage's folder holds, for each run, the rows that its work gave (``rows/run=...``) and what became of each input (``status/run=...``): its
fingerprint (path, size, time), done or failed with the error, and how many rows it gave by kind. The next run leaves out the inputs whose
latest status is done with the same fingerprint. The work is done in one pass, which writes its rows; status is counted from them. A
run that dies before its status is written has done nothing, and is done again, under its own name in the same place.

Cases: inputs without a change give an empty run; a failed input is tried again each time; an input that has gone keeps its last status and rows;
a null in a key is a key of its own; the same input twice is an error of the caller's listing and gives its rows twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .stage import StageResult

FINGERPRINT = ("path", "size", "time")


def fingerprints(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """path, size and time of the files under root, without their content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("time"))


def _runs(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.option("mergeSchema", "true").parquet(folder)
    except AnalysisException:  # no run yet
        return None


def latest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame | None:
    """The last status of each input of a stage; None before its first run."""
    runs = _runs(spark, f"{folder}/status")
    if runs is None:
        return None
    others = [c for c in runs.columns if c not in keys]
    last = runs.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col("run").cast("string")).alias("s"))
    return last.select(*keys, "s.*")


def changed(inputs: DataFrame, known: DataFrame | None, keys: list[str]) -> DataFrame:
    """The inputs that aren't done with their present fingerprint."""
    if known is None:
        return inputs
    done = known.filter("status = 'done'").select(*[F.col(c).alias(f"_d_{c}") for c in (*keys, *FINGERPRINT)])
    same = F.lit(True)
    for c in (*keys, *FINGERPRINT):
        same = same & F.col(c).eqNullSafe(F.col(f"_d_{c}"))
    return inputs.join(done, same, "left_anti")


def run_stage(inputs: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, keys: list[str], run: str | None = None, fail_fast: bool = False) -> StageResult:
    """Run ``work`` over the changed inputs (keys, path, size, time, and whatever work needs). work gives rows with the keys, ``error`` (null
    where all is well), ``kind`` (counted by input; null for an input without rows) and its results. (the run's rows, the run's status)."""
    spark, run = inputs.sparkSession, run or f"{time.time_ns():020d}"
    todo = changed(inputs, latest(spark, folder, keys), keys)
    given = work(todo)
    if fail_fast:
        given = given.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))))
    given.write.mode("overwrite").parquet(f"{folder}/rows/run={run}")
    rows = spark.read.schema(given.schema).parquet(f"{folder}/rows/run={run}")
    counted = _counted(rows, keys)
    listed = todo.select(*keys, *FINGERPRINT)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    status = listed.join(counted.select(*[F.col(k).alias(f"_c_{k}") for k in keys], "error", "counts"), same, "left").select(
        *keys, *FINGERPRINT, F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), "error", F.coalesce("counts", F.create_map().cast("map<string,bigint>")).alias("counts")
    )
    status.write.mode("overwrite").parquet(f"{folder}/status/run={run}")
    return StageResult(rows.filter("error IS NULL AND kind IS NOT NULL").drop("error"), spark.read.schema(status.schema).parquet(f"{folder}/status/run={run}"))


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """error and counts by kind of each input."""
    by_kind = rows.groupBy(*keys, "kind").agg(F.min("error").alias("error"), F.count("kind").alias("n"))
    entries = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull() & F.col("error").isNull(), F.struct("kind", "n"))))
    return by_kind.groupBy(*keys).agg(F.min("error").alias("error"), F.map_from_entries(entries).alias("counts"))


def results(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame | None:
    """The rows of each input's latest run, if it was done; None before the first run."""
    rows, known = _runs(spark, f"{folder}/rows"), latest(spark, folder, keys)
    if rows is None or known is None:
        return None
    of = known.filter("status = 'done'").select(*[F.col(k).alias(f"_l_{k}") for k in keys], F.col("run").alias("_l_run"))
    same = F.col("run").cast("string") == F.col("_l_run").cast("string")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_l_{k}"))
    return rows.join(of, same, "left_semi").filter("kind IS NOT NULL")
