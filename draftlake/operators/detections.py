"""Filtering view candidates on a page.

detections: sample_id, page, ord, view_id, x1, y1, x2, y2 (rounded; null if unreadable), score, page_width,
page_height, and, where the page image was read, features (see pictures.measure_crop).
layout: sample_id, page, ord, region_type, x1, y1, x2, y2.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.geometry import Box, numbered, rounded_box

PAGE, REGIONS = ["sample_id", "page"], "_regions"


@dataclass(frozen=True)
class FilterRules:
    """The thresholds of the candidate filter."""

    min_score: float = 0.5
    hard_min_score: float = 0.08
    strip_y2: float = 0.10
    strip_height: float = 0.08
    strip_score: float = 0.60
    dense_ink: float = 0.16
    dense_thick: float = 0.14
    dense_component: float = 0.10
    dense_components: int = 8
    line_ink: tuple[float, float] = (0.003, 0.12)
    line_component: float = 0.12
    line_components: int = 3
    layout_coverage: float = 0.35
    layout_types: tuple[str, ...] = ("revision_table", "title_or_tolerance_table", "tolerance_table", "hole_table")


def candidates_of(documents: DataFrame) -> DataFrame:
    """The candidates of documents of detections (sample_id, page, doc: a variant, and wrong: why there's none), as the filter takes them; a
    box that isn't four numbers is null. A document that's none, or holds none, gives one row, without ord. Regions of documents (with_regions) stay."""
    doc, met = F.col("doc"), [c for c in documents.columns if c == REGIONS]
    size = F.coalesce(V.size_of(V.field(doc, "$.image_size")), V.pair_of(V.field(doc, "$.image_size")))
    views = F.filter(V.field(doc, "$.views", "array<variant>"), V.is_object)
    wrong = F.when(F.col("wrong").isNotNull(), F.col("wrong")).when(~V.is_object(doc), "document is not an object")
    each = documents.select(*PAGE, *met, wrong.alias("error"), size.alias("size"), views.alias("views"))  # once a document, not once a candidate
    each = each.select(*PAGE, *met, "error", "size", F.posexplode_outer("views").alias("ord", "v"))
    box = rounded_box(V.field(F.col("v"), "$.bbox"))
    parts = each.select(*PAGE, *met, "error", "size", "ord", "v", box.alias("box"))
    return parts.select(
        *PAGE, *met, "error", "ord", V.field(F.col("v"), "$.view_id", "string").alias("view_id"), *[c.alias(n) for c, n in zip(Box.of_array(F.col("box")), Box._fields, strict=True)],
        V.field(F.col("v"), "$.score", "double").alias("score"), F.coalesce("size.width", F.lit(0)).alias("page_width"), F.coalesce("size.height", F.lit(0)).alias("page_height"),
    )


def filter_documents(documents: DataFrame, layout: DataFrame | None, rules: FilterRules = FilterRules()) -> DataFrame:
    """The filter as a batch stage (plans.batch): sample_id, page, error, kind (accepted or rejected), ord, view_id, box, reject_reason.
    Documents are read in one pass; rows without a candidate go through the rules with the others, and lose their verdict. layout: None where
    the documents have met their regions."""
    decided = decide(candidates_of(documents), layout, rules)
    candidate = F.col("error").isNull() & F.col("ord").isNotNull()
    kind = F.when(F.col("reject_reason").isNull(), "accepted").otherwise("rejected")
    return decided.select(*PAGE, "error", F.when(candidate, kind).alias("kind"), "ord", "view_id", *Box._fields, F.when(candidate, F.col("reject_reason")).alias("reject_reason"))


def with_regions(pages: DataFrame, layout: DataFrame, rules: FilterRules = FilterRules()) -> DataFrame:
    """pages (of documents or of detections) with the regions that reject, in their order, as one array."""
    rejecting = layout.filter(F.col("region_type").isin(*rules.layout_types))
    of = rejecting.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(F.col("ord").isNull().alias("unplaced"), F.col("ord").alias("region_ord"), "region_type", *Box._fields))).alias(REGIONS))
    return pages.join(of.hint("merge"), PAGE, "left")


def layout_hits(detections: DataFrame, layout: DataFrame | None, rules: FilterRules) -> DataFrame:
    """detections with layout_type: in region order, the first rejecting region's type. The regions of a page meet its detections as
    one array, so that detections are read once and keep their place; by sorting, as there are as many arrays as pages."""
    met = detections if REGIONS in detections.columns else with_regions(detections, layout, rules)
    covers = lambda r: Box.of().coverage_by(Box(*(r[c] for c in Box._fields))) >= rules.layout_coverage
    first = F.get(F.filter(REGIONS, covers), F.lit(0))["region_type"]
    return met.withColumn("layout_type", F.when(Box.of().area() > 0, first)).drop(REGIONS)


def _dense(features: Column, rules: FilterRules) -> Column:
    return (features["ink"] >= rules.dense_ink) & (features["thick"] >= rules.dense_thick) & (features["largest"] >= rules.dense_component) & (features["components"] <= rules.dense_components)


def _line_drawing(features: Column, rules: FilterRules) -> Column:
    return features["ink"].between(*rules.line_ink) & (features["largest"] <= rules.line_component) & (features["components"] >= rules.line_components)


def decide(detections: DataFrame, layout: DataFrame | None, rules: FilterRules = FilterRules()) -> DataFrame:
    """detections with reject_reason (null: accepted). The first rule that holds decides."""
    features = F.col("features") if "features" in detections.columns else F.lit(None).cast("struct<ink:double,thick:double,largest:double,components:int>")
    box, score = Box.of(), F.coalesce("score", F.lit(0.0))
    strip = (F.col("page_height") > 0) & (F.col("y2") <= F.col("page_height") * rules.strip_y2) & (box.height() <= F.col("page_height") * rules.strip_height)
    missing = F.greatest(*[c.isNull().cast("int") for c in box]) == 1
    joined = layout_hits(detections, layout, rules)
    reason = (
        F.when(missing | (box.area() <= 0), F.lit("invalid_bbox"))
        .when(F.col("layout_type").isNotNull(), F.concat(F.lit("layout_region_overlap:"), "layout_type"))
        .when(_dense(features, rules), F.lit("dense_text_or_stamp"))
        .when(strip & (score < rules.strip_score), F.lit("top_strip_low_score"))
        .when(score < rules.hard_min_score, F.lit("below_hard_min_score"))
        .when((score < rules.min_score) & ~F.coalesce(_line_drawing(features, rules), F.lit(False)), F.lit("below_min_score"))
    )
    return joined.withColumn("reject_reason", reason).drop("layout_type")


def accepted(decided: DataFrame) -> DataFrame:
    """The accepted views, numbered anew in the input's order; source_view_id keeps the old id."""
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("ord"))
    kept = decided.filter("reject_reason IS NULL").withColumn("_n", number)
    return kept.withColumn("source_view_id", F.coalesce("view_id", numbered("source_", F.col("_n")))).withColumn("view_id", numbered("view_", F.col("_n"))).drop("_n", "reject_reason")


def rejected(decided: DataFrame) -> DataFrame:
    return decided.filter("reject_reason IS NOT NULL").withColumn("source_view_id", F.coalesce("view_id", F.lit("")))


def summary(decided: DataFrame) -> DataFrame:
    return decided.agg(
        F.count(F.lit(1)).alias("input_count"),
        F.count_if(F.col("reject_reason").isNull()).alias("accepted_count"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("rejected_count"),
        F.countDistinct(*PAGE).alias("page_count"),
    )
