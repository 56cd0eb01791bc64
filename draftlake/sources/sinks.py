"""Writing stage results: tables by Spark's writers, single documents as JSON lines."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def pretty(text: Column) -> Column:
    """A JSON text as a document is kept: two spaces for each level, characters as they are, a newline at the end."""

    @pandas_udf(T.StringType())
    def laid_out(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(json.loads(t), ensure_ascii=False, indent=2) + "\n", na_action="ignore")

    return laid_out(text)


def json_files(documents: DataFrame, path: str = "output_path", text: str = "document") -> DataFrame:
    """name and content of each document as a file of a run (artefacts.write_run)."""
    return documents.select(F.col(path).alias("name"), pretty(F.col(text)).alias("content"))


def page_files(cleaned: DataFrame, stage: str = "04.CleanPNG") -> DataFrame:
    """name and content of the clean page and the mask of each page (sample_id, page, clean, mask)."""
    stem = F.format_string(f"{stage}/%s/page_%03d_", F.col("sample_id").cast("string"), F.col("page").cast("int"))
    each = F.explode(F.array(*[F.struct(F.concat(stem, F.lit(f"{kind}.png")).alias("name"), F.col(of).alias("content")) for kind, of in (("clean", "clean"), ("remove_mask", "mask"))]))
    return cleaned.select(each.alias("f")).select("f.*").filter("content IS NOT NULL")


def run_texts(runs: DataFrame) -> DataFrame:
    """name and content of what a model was asked and answered: runs has sample_id and any of prompt, script, raw; null ones have no
    file."""
    kinds = {"prompt": "prompt.md", "script": "cadquery.py", "raw": "raw_response.txt"}
    there = [F.struct(F.concat_ws("/", F.col("sample_id").cast("string"), F.lit(name)).alias("name"), F.col(kind).alias("content")) for kind, name in kinds.items() if kind in runs.columns]
    return runs.select(F.explode(F.array(*there)).alias("f")).select("f.*").filter("content IS NOT NULL")


def write_documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a row, nulls kept."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def append_documents(df: DataFrame, path: str) -> None:
    write_documents(df, path, "append")


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """CSV with a header; lists joined by semicolons, booleans as True and False, nulls empty."""
    columns = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind.startswith("array"):
            c = F.array_join(c, ";")
        elif kind == "boolean":
            c = F.when(c, "True").when(~c, "False")
        columns.append(c.alias(name))
    df.select(*columns).write.mode("overwrite").option("emptyValue", "").csv(path, header=True)


def keep_raw(df: DataFrame, path: str) -> None:
    """Write once: an earlier raw table is never replaced."""
    df.write.mode("ignore").parquet(path)
