"""Page pictures drawn from the suppliers table, each of a kind whose regions, crops and decisions can be said in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pictures import encode_png

KINDS, PARTS = 5, 64
#: Of each kind: region type, times, box (x1 and x2 shift by the page's offset), confidence.
EXPECTED_SQL = """kinds(kind, region_type, x1, y1, x2, y2, confidence) AS (VALUES
  (0, 'title_or_tolerance_table', 428, 538, 984, 700, 0.9), (1, 'revision_table', 698, 0, 984, 124, 0.772),
  (2, 'inner_frame_strip', 40, 24, 79, 678, 0.88), (2, 'inner_frame_strip', 914, 24, 953, 678, 0.88),
  (3, 'corner_metadata_box', 766, 16, 966, 104, 0.82), (4, 'technical_requirements', 33, 498, 181, 632, 0.78))"""


def _line(page: np.ndarray, x1: int, y1: int, x2: int, y2: int, width: int = 2) -> None:
    """A black line of so many pixels from (x1, y1) on, upright or level."""
    page[y1 : (y1 + width if y1 == y2 else y2), x1 : (x1 + width if x1 == x2 else x2)] = 0


def _grid(page: np.ndarray, x1: int, y1: int, x2: int, y2: int, rows: int, columns: int) -> None:
    for i in range(rows + 1):
        y = y1 + (y2 - y1) * i // rows
        _line(page, x1, y, x2 + 2, y)
    for i in range(columns + 1):
        x = x1 + (x2 - x1) * i // columns
        _line(page, x, y1, x, y2 + 2)


def draw(kind: int, off: int) -> np.ndarray:
    page = np.full((1200 if kind == 1 else 700, 1000), 255, np.uint8)
    if kind == 0:
        _grid(page, 450 + off, 560, 960 + off, 680, 5, 8)
    elif kind == 1:
        _grid(page, 720 + off, 20, 960 + off, 100, 1, 4)
    elif kind == 2:
        _line(page, 58 + off, 42, 58 + off, 660, 3)
        _line(page, 932 + off, 42, 932 + off, 660, 3)
    elif kind == 3:
        _grid(page, 780 + off, 30, 950 + off, 88, 1, 2)
    else:  # written notes
        for y in range(520, 601, 20):
            for x in range(55 + off, 155 + off, 12):
                page[y : y + 10, x : x + 8] = 0
    return page


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image and data (PNG) of a page for each supplier."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 64):
                part = batch.iloc[low : low + 64]
                yield pd.DataFrame({"image": part["s_suppkey"], "data": [encode_png(draw(int(k) % KINDS, int(k) // KINDS % 7)) for k in part["s_suppkey"]]})

    # a page is work for milliseconds, and the table one small file
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long")).repartition(PARTS).mapInPandas(run, "image long, data binary")


#: A page with a black and a coloured block, and boxes: around both, the coloured one, none, one that has no area, one beyond the page.
COLOUR_BOXES = ((0, 0, 200, 120), (100, 20, 180, 100), (210, 0, 230, 20), (5, 5, 5, 9), (90, -50, 300, 400))
COLOUR_SQL = f"""SELECT s_suppkey AS image, b.x1, b.y1, b.x2, b.y2, CASE b.k WHEN 0 THEN round(c / (c + d), 6) WHEN 1 THEN 1.0 WHEN 4 THEN 1.0 ELSE 0.0 END::DOUBLE AS coloured
  FROM (SELECT s_suppkey, (10 + s_suppkey % 7) * 40 AS d, (20 + s_suppkey % 11) * 30 AS c FROM supplier), (VALUES {', '.join(f'({k}, {x1}, {y1}, {x2}, {y2})' for k, (x1, y1, x2, y2) in enumerate(COLOUR_BOXES))}) b(k, x1, y1, x2, y2)"""


def draw_colours(key: int) -> np.ndarray:
    page = np.full((120, 240, 3), 255, np.uint8)
    page[20 : 30 + key % 7, 30:70] = 20
    page[30 : 50 + key % 11, 110:140] = (150, 10, 30)
    page[60:110, 150:190] = (255, 160, 160)  # coloured, but not dark
    return page


def colour_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pictures, regions) of a page with coloured ink for each supplier."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("image"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(data=[encode_png(draw_colours(int(k))) for k in batch["image"]])

    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), b, strict=True)]) for b in COLOUR_BOXES]))
    return suppliers.repartition(PARTS).mapInPandas(run, "image long, data binary"), suppliers.select("image", each.alias("b")).select("image", "b.*")


#: Boxes on a page of views: a stamp, a thin drawing, an empty one of low score, an empty one of high score, one that two
#: regions cover, one without a picture.
CANDIDATES = ((0, 100, 100, 200, 200, 0.9), (1, 300, 100, 420, 220, 0.2), (2, 500, 100, 600, 200, 0.2), (3, 500, 300, 600, 400, 0.9), (4, 100, 400, 200, 500, 0.9))
DECISIONS_SQL = """SELECT s_suppkey AS sample_id, c.ord, CASE WHEN c.ord = 0 AND s_suppkey % 3 <> 0 THEN 'dense_text_or_stamp'
    WHEN c.ord = 1 AND s_suppkey % 3 <> 0 THEN NULL WHEN c.ord IN (1, 2) THEN 'below_min_score' WHEN c.ord = 4 THEN 'layout_region_overlap:revision_table' END AS reject_reason,
    CASE WHEN s_suppkey % 3 <> 0 THEN 640 ELSE 0 END AS page_width
  FROM supplier, (VALUES (0), (1), (2), (3), (4)) c(ord)"""


def draw_views(off: int) -> np.ndarray:
    page = np.full((600, 640), 255, np.uint8)
    page[110 + off : 170 + off, 110:170] = 0  # 36 % of its box
    for i in range(4):
        page[110 + 20 * i + off, 310:400] = 0
    return page


def view_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, pictures, layout) of a page for each supplier; every third page has no picture."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("sample_id"), F.lit(1).alias("page"))
    each = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("ord", "x1", "y1", "x2", "y2", "score"), c, strict=True)]) for c in CANDIDATES])
    candidates = suppliers.select("*", F.explode(each).alias("c")).select("sample_id", "page", "c.*").withColumn("view_id", F.format_string("view_%03d", "ord"))
    region = lambda i, kind: F.struct(F.lit(i).alias("ord"), F.lit(kind).alias("region_type"), F.lit(90).alias("x1"), F.lit(390).alias("y1"), F.lit(210).alias("x2"), F.lit(510).alias("y2"))
    layout = suppliers.select("*", F.explode(F.array(region(2, "hole_table"), region(1, "revision_table"), region(0, "page_border"))).alias("r")).select("sample_id", "page", "r.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = [encode_png(draw_views(int(k) % 11)) if k % 3 else b"no picture" for k in batch["sample_id"]]
            yield batch.assign(data=data)

    return candidates, suppliers.repartition(PARTS).mapInPandas(run, "sample_id long, page int, data binary"), layout
