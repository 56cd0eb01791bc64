"""Scoring model answers against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalised_dimension


def cases(split: DataFrame, asked: Column | None = None) -> DataFrame:
    """split(sample_id, input_images, tasks, truth map) → a row per task, with the task's truth and a default
    page image where the case has none."""
    images = F.when(F.size("input_images") > 0, F.col("input_images")).otherwise(F.array(F.format_string("%s/page_001.png", F.col("sample_id").cast("string"))))
    tasks = F.col("tasks") if asked is None else F.array_intersect("tasks", asked)
    return split.withColumn("input_images", images).withColumn("task", F.explode(tasks)).withColumn("task_truth", F.try_element_at("truth", F.col("task"))).drop("tasks", "truth")


def _counts(tokens: Column) -> Column:
    """How often each of an array's distinct tokens occurs, beside the token."""
    return F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("t"), F.size(F.filter(tokens, lambda o: o == t)).alias("n")))


def token_f1(predicted: Column, truth: Column) -> Column:
    """F1 of two lists of dimension texts as multisets."""
    a, b = (F.transform(F.filter(x, lambda t: t.isNotNull() & (t != "")), normalised_dimension) for x in (predicted, truth))
    shared = F.aggregate(_counts(a), F.lit(0), lambda total, c: total + F.least(c["n"], F.size(F.filter(b, lambda o: o == c["t"]))))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0) | (shared == 0), 0.0).otherwise(2 * shared / (F.size(a) + F.size(b)))


def count_accuracy(predicted: Column, truth: Column) -> Column:
    """Share of the feature types in either map with equal counts, absent ones being 0."""
    keys = F.array_union(F.map_keys(predicted), F.map_keys(truth))
    zero = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0))
    right = F.size(F.filter(keys, lambda k: zero(predicted, k) == zero(truth, k)))
    return F.when(F.size(keys) == 0, 1.0).otherwise(right / F.size(keys))


def exact_match(predicted: Column, truth: Column) -> Column:
    return F.when(predicted.eqNullSafe(truth), 1.0).otherwise(0.0)


def score(records: DataFrame) -> DataFrame:
    """records(task, valid, view_count, dims, counts and the same with true_) with score; null where a task has
    none or the answer is no JSON."""
    by_task = (
        F.when(F.col("task") == "view_count", exact_match(F.col("view_count"), F.col("true_view_count")))
        .when(F.col("task") == "dimension_ocr", token_f1(F.col("dims"), F.col("true_dims")))
        .when(F.col("task") == "feature_count", count_accuracy(F.col("counts"), F.col("true_counts")))
    )
    return records.withColumn("score", F.when(F.col("valid"), by_task))


def metrics(scored: DataFrame, *by: str) -> DataFrame:
    rate = F.coalesce(F.avg(F.col("valid").cast("double")), F.lit(0.0))
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("num_records"), rate.alias("json_parse_rate"), F.avg("score").alias("mean_score"), F.count("score").alias("num_scored_records"))
