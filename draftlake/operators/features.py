"""What models predicted for a sample, brought together: dimensions, feature candidates, modelling steps.

predictions: sample_id, ord (order of the records), task, model, and by task dimensions array<struct<text,
normalized>>, feature_counts map<string,int>, evidence array<string>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import numbered
from ..functions.text import dimension_value, leading_quantity, mentions_thread, normalised_dimension

#: The step for each feature type, in the order of the plan; a first and a last step.
STEPS = (
    ("through_hole", "cut_through_hole_pattern"),
    ("counterbore", "cut_counterbore_or_spotface_pattern"),
    ("blind_hole", "cut_blind_hole_pattern"),
    ("side_hole", "cut_side_hole_pattern"),
    ("slot", "cut_slot"),
    ("chamfer", "apply_chamfer"),
    ("fillet", "apply_fillet"),
)
FIRST_STEP, THREAD_STEP = "create_base_solid", "represent_threaded_holes"


def label_histogram(crops: DataFrame) -> DataFrame:
    """crops(sample_id, labels array<string>) → sample_id, label, n; a missing label is unknown."""
    return crops.select("sample_id", F.explode("labels").alias("label")).groupBy("sample_id", F.coalesce("label", F.lit("unknown")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def dimensions(predictions: DataFrame) -> DataFrame:
    """Distinct dimensions of each sample, the first of each (text, normalized), numbered in order."""
    each = predictions.filter("task = 'dimension_ocr'").select("sample_id", "ord", "model", F.posexplode("dimensions").alias("pos", "d"))
    each = each.select("sample_id", "ord", "pos", "model", F.coalesce("d.text", F.lit("")).alias("text"), F.coalesce(F.when(F.col("d.normalized") != "", F.col("d.normalized")), "d.text").alias("normalized")).filter("text <> ''")
    first = F.row_number().over(Window.partitionBy("sample_id", "text", "normalized").orderBy("ord", "pos"))
    kept = each.withColumn("_first", first).filter("_first = 1")
    number = F.row_number().over(Window.partitionBy("sample_id").orderBy("ord", "pos"))
    return kept.select("sample_id", numbered("d", number).alias("id"), "text", "normalized", "model", dimension_value(F.col("normalized")).alias("value"), leading_quantity(F.col("normalized")).alias("quantity"))


def candidates(predictions: DataFrame) -> DataFrame:
    """Feature types of each sample: the greatest count, the models of the records that saw it, the evidence in order."""
    records = predictions.filter("task = 'feature_count'")
    counts = records.select("sample_id", "ord", "model", "evidence", F.explode("feature_counts").alias("type", "count")).withColumn("count", F.coalesce("count", F.lit(0)))
    # the models that saw it, in the order of their records
    models = F.array_sort(F.collect_list(F.when(F.col("count") > 0, F.struct("ord", "model"))))
    seen = counts.groupBy("sample_id", "type").agg(F.max("count").alias("count"), F.transform(models, lambda m: m["model"]).alias("sources"))
    said = counts.filter("count > 0").select("sample_id", "type", "ord", F.posexplode("evidence").alias("pos", "text"))
    once = said.groupBy("sample_id", "type", "text").agg(F.min(F.struct("ord", "pos")).alias("at"))
    evidence = once.groupBy("sample_id", "type").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda e: e["text"]).alias("evidence"))
    number = F.row_number().over(Window.partitionBy("sample_id").orderBy("type"))
    status = F.when(F.col("count") > 0, "candidate").otherwise("not_detected")
    return seen.join(evidence, ["sample_id", "type"], "left").select(
        "sample_id", numbered("f", number).alias("id"), "type", "count", "sources", F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"), status.alias("status")
    )


def plan(samples: DataFrame, found: DataFrame, dims: DataFrame) -> DataFrame:
    """Modelling steps of each sample, numbered: the base, a step per feature type seen, threads if mentioned."""
    spark = samples.sparkSession
    steps = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(STEPS)], "step_ord int, type string, operation string")
    own = found.filter("count > 0").join(F.broadcast(steps), "type").select("sample_id", "step_ord", "operation", "count")  # as many rows as STEPS
    base = samples.select("sample_id").distinct().select("sample_id", F.lit(-1).alias("step_ord"), F.lit(FIRST_STEP).alias("operation"), F.lit(1).alias("count"))
    texts = dims.select("sample_id", normalised_dimension(F.col("normalized")).alias("t")).unionByName(found.select("sample_id", F.explode("evidence").alias("t")))
    threads = texts.groupBy("sample_id").agg(F.bool_or(mentions_thread(F.array("t"))).alias("m")).filter("m").select("sample_id", F.lit(len(STEPS)).alias("step_ord"), F.lit(THREAD_STEP).alias("operation"), F.lit(1).alias("count"))
    number = F.row_number().over(Window.partitionBy("sample_id").orderBy("step_ord"))
    return base.unionByName(own).unionByName(threads).select("sample_id", numbered("op", number).alias("id"), "operation", "count")


def mentions_sample(sample_id: Column, images: Column) -> Column:
    """Whether a prediction's images belong to a sample: by substring, as paths hold the id."""
    return F.exists(images, lambda p: F.contains(p, sample_id))
