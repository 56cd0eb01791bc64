"""What every batch stage shares: errors as rows, and whether to stop at the first."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class StageResult(NamedTuple):
    """The rows that worked, and a status row for each input."""

    result: DataFrame
    status: DataFrame


def split(rows: DataFrame, keys: list[str], fail_fast: bool = False) -> StageResult:
    """rows with an error column, parted. With fail_fast the first row with an error stops the job that reads
    the result."""
    if fail_fast:
        rows = rows.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))))
    status = rows.select(*keys, F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), "error")
    return StageResult(rows.filter("error IS NULL").drop("error"), status)


def counts(status: DataFrame) -> DataFrame:
    return status.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"))
