"""Stage inputs derived from the driver's tables by integer arithmetic that Spark and DuckDB agree on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The order of a sample's lines; unique at every scale.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
PAGE_WIDTH, PAGE_HEIGHT = 1000, 700
BOX_SQL = {
    "x1": "l_partkey * 13 % 700",
    "y1": "l_suppkey * 29 % 500",
    "x2": "l_partkey * 13 % 700 + 40 + CAST(l_quantity AS INT) * 5",
    "y2": "l_suppkey * 29 % 500 + 20 + l_partkey % 23 * 12",
}
LAYOUT_TYPES = {"1-URGENT": "title_or_tolerance_table", "2-HIGH": "revision_table", "3-MEDIUM": "hole_table", "4-NOT SPECIFIED": "page_border", "5-LOW": "technical_requirements"}

DETECTIONS_SQL = f"""detections AS (
  SELECT l_orderkey AS sample_id, 1 AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS INT) AS ord,
         {', '.join(f'CAST({e} AS INT) AS {c}' for c, e in BOX_SQL.items())}, (l_partkey % 100) / 100.0::DOUBLE AS score, l_suppkey, l_returnflag, l_tax, l_linestatus
  FROM lineitem)"""
LAYOUT_SQL = f"""layout AS (
  SELECT o_orderkey AS sample_id, 1 AS page, 1 AS ord,
         CASE o_orderpriority {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in LAYOUT_TYPES.items())} END AS region_type,
         CAST(o_custkey * 7 % 500 AS INT) AS x1, CAST(o_custkey * 11 % 300 AS INT) AS y1, CAST(o_custkey * 7 % 500 + 400 AS INT) AS x2, CAST(o_custkey * 11 % 300 + 300 AS INT) AS y2
  FROM orders)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _candidates(lines: DataFrame, ord_: Column, kept: Sequence[str]) -> DataFrame:
    return lines.select(
        F.col("l_orderkey").alias("sample_id"), F.lit(1).alias("page"), ord_.alias("ord"), *[F.expr(e).cast("int").alias(c) for c, e in BOX_SQL.items()],
        (F.col("l_partkey") % 100 / 100.0).alias("score"), F.lit(PAGE_WIDTH).alias("page_width"), F.lit(PAGE_HEIGHT).alias("page_height"), *kept,
    ).withColumn("view_id", F.format_string("view_%03d", "ord"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One view candidate per line of an order."""
    ord_ = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    return _candidates(table(spark, sf_dir, "lineitem"), ord_, ("l_suppkey", "l_returnflag", "l_tax", "l_linestatus"))


def shared_detections(spark: SparkSession, sf_dir: str, *kept: str) -> DataFrame:
    """The same of lines that have an order, with fewer columns, for what's made of them several times: the lines of a sample meet as one
    array, whatever of it is used, so that all uses in a plan share one exchange of the lines and what's joined by sample needs no other."""
    # said of the key as text too, as a plan does where samples are named by text: what's read before the exchange must be the same for all
    lines = table(spark, sf_dir, "lineitem").filter("l_orderkey IS NOT NULL AND CAST(l_orderkey AS STRING) IS NOT NULL")
    whole = F.sort_array(F.collect_list(F.struct(*LINE_ORDER, "l_quantity", *[c for c in kept if c not in LINE_ORDER])))
    each = lines.groupBy("l_orderkey").agg(whole.alias("lines")).select("l_orderkey", F.posexplode("lines").alias("at", "line"))
    return _candidates(each.select("l_orderkey", "at", "line.*"), F.col("at") + 1, kept)


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One layout region per order."""
    orders = table(spark, sf_dir, "orders")
    kinds = F.create_map(*[F.lit(x) for pair in LAYOUT_TYPES.items() for x in pair])
    x, y = F.col("o_custkey") * 7 % 500, F.col("o_custkey") * 11 % 300
    return orders.select(
        F.col("o_orderkey").alias("sample_id"), F.lit(1).alias("page"), F.lit(1).alias("ord"), F.try_element_at(kinds, F.col("o_orderpriority")).alias("region_type"),
        x.cast("int").alias("x1"), y.cast("int").alias("y1"), (x + 400).cast("int").alias("x2"), (y + 300).cast("int").alias("y2"),
    )


#: Samples with a document of detections, of single views, of accepted views: by columns of orders.
DETECTED, EXPORTED, ACCEPTED = "o_orderpriority <> '1-URGENT'", "o_orderpriority <> '5-LOW'", "o_orderstatus <> 'P'"
ACCEPTED_SQL = f"sample_id IN (SELECT o_orderkey FROM orders WHERE {ACCEPTED})"
VIEWS_SQL = f"""views AS (
  SELECT sample_id, ord, x1 + CAST(l_suppkey % 5 AS INT) AS x1, y1 + CAST(l_suppkey % 5 AS INT) AS y1, x2 + CAST(l_suppkey % 5 AS INT) AS x2, y2 + CAST(l_suppkey % 5 AS INT) AS y2, score, l_tax
  FROM detections WHERE l_returnflag <> 'R'),
accepted AS (SELECT * FROM detections WHERE score >= 0.5 AND {ACCEPTED_SQL})"""


def views(found: DataFrame) -> DataFrame:
    """Crops of the detections that weren't returned, a few pixels off."""
    off = (F.col("l_suppkey") % 5).cast("int")
    return found.filter("l_returnflag <> 'R'").withColumns({c: F.col(c) + off for c in ("x1", "y1", "x2", "y2")})


def samples(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Samples that have a document."""
    return table(spark, sf_dir, "orders").filter(which).select(F.col("o_orderkey").alias("sample_id"))


def of_samples(found: DataFrame, sf_dir: str, which: str) -> DataFrame:
    """What belongs to samples that have a document."""
    return found.join(samples(found.sparkSession, sf_dir, which), "sample_id", "left_semi")


def accepted(found: DataFrame, sf_dir: str) -> DataFrame:
    """Detections taken as accepted, where the sample has a document of them."""
    return of_samples(found.filter("score >= 0.5"), sf_dir, ACCEPTED)


#: What's wrong with the documents of orders whose status is P, by priority.
BROKEN = {"1-URGENT": "trailing", "2-HIGH": "page", "3-MEDIUM": "box", "4-NOT SPECIFIED": "ids", "5-LOW": "list"}


#: What records need of lines besides their boxes.
RECORD_LINES = ("l_suppkey", "l_returnflag", "l_tax", "l_linestatus")
IMAGE_SIZE = {"width": PAGE_WIDTH, "height": PAGE_HEIGHT}


def _size() -> Column:
    return F.struct(*[F.lit(v).alias(c) for c, v in IMAGE_SIZE.items()]).alias("image_size")


def _document_path(stage: str, name: str) -> Column:
    return F.format_string(f"DataFlow/{stage}/%d/page_001_{name}.json", F.col("sample_id")).alias("path")


def _faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of orders with status P each kind of priority has a fault of its own."""
    broken = F.when(F.col("o_orderstatus") == "P", F.try_element_at(F.create_map(*[F.lit(x) for pair in BROKEN.items() for x in pair]), F.col("o_orderpriority")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), broken.alias("fault"))


def detection_documents(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """sample_id (a number), page, path and text of the documents of detections, with their faults."""
    box = F.array("x1", "y1", "x2", "y2")
    found = lines.join(_faults(spark, sf_dir), "sample_id", "left").withColumn("last", F.max("ord").over(Window.partitionBy("sample_id")) == F.col("ord"))
    fine = F.col("score") >= 0.5
    cut = F.when((F.col("fault") == "box") & F.col("last"), F.slice(box, 1, 3)).otherwise(box)
    named = lambda name: F.when((F.col("fault") == "ids") & (F.col("ord") == 1), F.lit(None)).otherwise(name)
    view = F.struct("ord", named(F.when(fine, F.concat(F.lit("a_"), F.col("view_id")))).alias("view_id"), named(F.col("view_id")).alias("source_view_id"), cut.alias("bbox"), "score", F.lit("detector").alias("source"), F.struct(fine.alias("accepted")).alias("filter"))
    views_of = found.groupBy("sample_id", "fault").agg(F.array_sort(F.collect_list(view)).alias("views"))
    text = F.when(F.col("fault") == "list", "[]").otherwise(F.to_json(F.struct(F.col("sample_id").cast("string").alias("sample_id"), _size(), "views")))
    return views_of.select("sample_id", F.lit(1).alias("page"), _document_path("05.ViewDetection", "views"), text.alias("text"))


def record_inputs(spark: SparkSession, sf_dir: str, lines: DataFrame, classified: DataFrame, skipped: DataFrame) -> tuple[DataFrame, ...]:
    """Documents of detections, of classified views and of crops, and a listing, as a drawing's record is built from. Crops of lines
    without tax have no metadata. lines: shared_detections with RECORD_LINES."""
    sample, page = F.col("sample_id").cast("string").alias("sample_id"), F.lit(1).alias("page")
    detected = detection_documents(spark, sf_dir, lines).withColumn("sample_id", sample)
    crop = F.when(F.col("view_type") == "front", F.struct((F.col("x2") - F.col("x1") + 1).alias("width"), (F.col("y2") - F.col("y1") + 1).alias("height")))
    seen = F.struct("ord", "view_id", F.col("view_type").alias("type"), "confidence", F.array("reason").alias("reasons"), F.array("x1", "y1", "x2", "y2").alias("bbox_on_page"), F.col("needs_review").alias("needs_manual_review"), crop.alias("crop_size"))
    # each left of the lines' samples, so that nothing is moved again
    kept, left_out = classified.groupBy("sample_id").agg(F.array_sort(F.collect_list(seen)).alias("views")), skipped.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("ord", "view_id"))).alias("skipped_views"))
    classes = lines.select("sample_id").distinct().join(kept, "sample_id", "left").join(left_out, "sample_id", "left").filter("views IS NOT NULL OR skipped_views IS NOT NULL").join(_faults(spark, sf_dir), "sample_id", "left")
    number = F.when(F.col("fault") == "page", 2).otherwise(1).alias("page")
    text = F.concat(F.to_json(F.struct(sample, number, _size(), F.coalesce("views", F.array()).alias("views"), "skipped_views")), F.when(F.col("fault") == "trailing", "{}").otherwise(""))
    classes = classes.select(sample, page, _document_path("07.ViewClassification", "view_classification"), text.alias("text"))
    crops = views(lines)
    folder = F.format_string("DataFlow/06.SingleViews/%d/%s/", F.col("sample_id"), F.col("view_id"))
    metadata = crops.filter("l_tax <> 0").select(sample, "view_id", F.concat(folder, F.lit("view_metadata.json")).alias("path"), F.to_json(F.struct(F.struct((F.col("x2") - F.col("x1")).alias("width"), F.col("ord").alias("height")).alias("crop_size"))).alias("text"))
    pictures = crops.filter("l_linestatus = 'F'").select(F.concat(folder, F.lit("clean_view_with_annotations.png")).alias("path"))
    return detected, classes, metadata, pictures


RECORD_SQL = f"""u AS (SELECT t.*, d.l_linestatus FROM t JOIN detections d USING (sample_id, ord)),
z AS (SELECT o_orderkey AS sample_id, CASE WHEN o_orderstatus = 'P' THEN CASE o_orderpriority {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in BROKEN.items())} END END AS fault FROM orders),
dm AS (SELECT sample_id, max(ord) AS last, max_by(score, ord) AS last_score, min_by(score, ord) AS first_score FROM detections GROUP BY 1),
hs AS (
  SELECT u.sample_id, u.ord, d.ord AS hit, row_number() OVER (PARTITION BY u.sample_id, u.ord ORDER BY
         (greatest(0, least(u.x2, d.x2) - greatest(u.x1, d.x1)) * greatest(0, least(u.y2, d.y2) - greatest(u.y1, d.y1))) / least(greatest(1, (u.x2 - u.x1) * (u.y2 - u.y1)), greatest(1, (d.x2 - d.x1) * (d.y2 - d.y1))) DESC, d.ord) AS r,
         (greatest(0, least(u.x2, d.x2) - greatest(u.x1, d.x1)) * greatest(0, least(u.y2, d.y2) - greatest(u.y1, d.y1))) / least(greatest(1, (u.x2 - u.x1) * (u.y2 - u.y1)), greatest(1, (d.x2 - d.x1) * (d.y2 - d.y1))) AS share
  FROM u JOIN detections d ON d.sample_id = u.sample_id AND d.score >= 0.5),
ve AS (
  SELECT u.*, h.hit, d.x1 AS dx1, d.y1 AS dy1, d.x2 AS dx2, d.y2 AS dy2, 'DataFlow/06.SingleViews/' || u.sample_id || '/' || printf('view_%03d', u.ord) || '/' AS folder,
         CASE WHEN u.l_tax = 0 THEN 'Missing view_metadata.json for ' || u.sample_id || '/' || printf('view_%03d', u.ord) || ': DataFlow/06.SingleViews/' || u.sample_id || '/' || printf('view_%03d', u.ord) || '/view_metadata.json'
              WHEN h.hit IS NULL THEN 'Classified view ' || u.sample_id || '/' || printf('view_%03d', u.ord) || ' does not match any accepted 05.ViewDetection bbox' END AS fault
  FROM u LEFT JOIN (SELECT * FROM hs WHERE r = 1 AND share >= 0.85) h USING (sample_id, ord) LEFT JOIN detections d ON d.sample_id = u.sample_id AND d.ord = h.hit),
va AS (
  SELECT sample_id, count(*) AS view_count, min_by(fault, ord) FILTER (WHERE fault IS NOT NULL) AS view_fault,
         string_agg(concat_ws('|', printf('view_%03d', ord), view_type, '[' || x1 || ',' || y1 || ',' || x2 || ',' || y2 || ']', CASE WHEN view_type = 'front' THEN x2 - x1 + 1 ELSE x2 - x1 END,
           CASE WHEN l_linestatus = 'F' THEN folder || 'clean_view_with_annotations.png' END, 'a_' || printf('view_%03d', hit), printf('view_%03d', hit), '[' || dx1 || ',' || dy1 || ',' || dx2 || ',' || dy2 || ']'), ';' ORDER BY ord) AS told
  FROM ve GROUP BY 1),
sk AS (SELECT sample_id, count(*) AS skipped FROM kept WHERE NOT stays GROUP BY 1),
b AS (
  SELECT coalesce(va.sample_id, sk.sample_id) AS sample_id, coalesce(view_count, 0) AS view_count, coalesce(skipped, 0) AS skipped, coalesce(told, '') AS told,
         CASE WHEN z.fault = 'trailing' THEN 'Trailing data after JSON document in ' || c WHEN z.fault = 'list' THEN 'Detection JSON must be an object: ' || p
              WHEN z.fault = 'box' AND last_score >= 0.5 THEN 'Accepted detection view #' || last || ' in ' || p || ' is missing bbox'
              WHEN z.fault = 'ids' AND first_score >= 0.5 THEN 'Accepted detection view #1 in ' || p || ' is missing view_id/source_view_id'
              WHEN z.fault = 'page' THEN 'View classification page mismatch in ' || c ELSE view_fault END AS error
  FROM va FULL JOIN sk ON va.sample_id = sk.sample_id JOIN z ON z.sample_id = coalesce(va.sample_id, sk.sample_id) JOIN dm ON dm.sample_id = z.sample_id,
    LATERAL (SELECT 'DataFlow/05.ViewDetection/' || z.sample_id || '/page_001_views.json' AS p, 'DataFlow/07.ViewClassification/' || z.sample_id || '/page_001_view_classification.json' AS c))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model records from events: k of the props decides dimensions, counts and evidence."""
    k = F.get_json_object("props", "$.k").cast("int")
    task = F.when(F.col("event_id") % 2 == 0, "dimension_ocr").otherwise("feature_count")
    dim = lambda n: F.concat((n % 5).cast("string"), F.lit("-M"), n.cast("string"))
    return table(spark, sf_dir, "events").withColumn("k", k).select(
        F.col("user_id").alias("sample_id"), F.col("event_id").alias("ord"), task.alias("task"), F.col("event_type").alias("model"),
        F.array(F.struct(dim(F.col("k")).alias("text"), F.lit("").alias("normalized")), F.struct(dim(F.col("k") + 1).alias("text"), F.concat(F.lit("Φ"), F.col("k").cast("string")).alias("normalized"))).alias("dimensions"),
        F.create_map(F.lit("through_hole"), F.col("k") % 4, F.lit("slot"), F.col("k") % 3, F.lit("chamfer"), F.lit(0)).alias("feature_counts"),
        F.array(F.concat(F.lit("note "), (F.col("k") % 7).cast("string"))).alias("evidence"), "k",
    )


PREDICTIONS_SQL = """predictions AS (
  SELECT user_id AS sample_id, event_id AS ord, event_id % 2 = 0 AS is_dim, event_type AS model, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""
DIMENSIONS_SQL = """each AS (
  SELECT sample_id, ord, 0 AS pos, (k % 5) || '-M' || k AS text, (k % 5) || '-M' || k AS normalized FROM predictions WHERE is_dim
  UNION ALL SELECT sample_id, ord, 1, ((k + 1) % 5) || '-M' || (k + 1), 'Φ' || k FROM predictions WHERE is_dim),
firsts AS (SELECT *, row_number() OVER (PARTITION BY sample_id, text, normalized ORDER BY ord, pos) AS f FROM each),
dims AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ord, pos) AS n FROM firsts WHERE f = 1)"""


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dark pixels of each embedding read as an 8 x 8 picture: where the value is positive."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "v")).filter("v > 0")
    return vectors.select(F.col("vec_id").alias("image"), F.floor(F.col("at") / 8).cast("int").alias("y"), (F.col("at") % 8).cast("int").alias("x"))


RASTERS_SQL = """pixels AS (
  SELECT vec_id AS image, (place - 1) // 8 AS y, (place - 1) % 8 AS x FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS place FROM embeddings) WHERE v > 0)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sides of every detection as line segments."""
    found = detections(spark, sf_dir)
    top = found.select(F.col("sample_id").alias("image"), (F.col("ord") * 2).alias("node"), F.lit(True).alias("horizontal"), "x1", "y1", "x2", F.col("y1").alias("y2"))
    left = found.select(F.col("sample_id").alias("image"), (F.col("ord") * 2 + 1).alias("node"), F.lit(False).alias("horizontal"), F.col("x1"), "y1", F.col("x1").alias("x2"), "y2")
    return top.unionByName(left)


SEGMENTS_SQL = """segments AS (
  SELECT sample_id AS image, ord * 2 AS node, true AS horizontal, x1, y1, x2, y1 AS y2 FROM detections
  UNION ALL SELECT sample_id, ord * 2 + 1, false, x1, y1, x1, y2 FROM detections),
pairs AS (
  SELECT h.image, h.node AS a, v.node AS b FROM segments h JOIN segments v USING (image)
  WHERE h.horizontal AND NOT v.horizontal AND v.x1 BETWEEN h.x1 - 14 AND h.x2 + 14 AND h.y1 BETWEEN v.y1 - 14 AND v.y2 + 14
  UNION ALL
  SELECT s.image, s.node, t.node FROM segments s JOIN segments t USING (image) WHERE s.node < t.node AND s.horizontal AND t.horizontal AND abs(s.y1 - t.y1) <= 14 AND greatest(s.x1, t.x1) <= least(s.x2, t.x2) + 14
  UNION ALL
  SELECT s.image, s.node, t.node FROM segments s JOIN segments t USING (image) WHERE s.node < t.node AND NOT s.horizontal AND NOT t.horizontal AND abs(s.x1 - t.x1) <= 14 AND greatest(s.y1, t.y1) <= least(s.y2, t.y2) + 14)"""
