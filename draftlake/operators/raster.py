"""Rasters as rows of pixels: runs, stencils, components and line segments as joins and windows.

A raster is a set of rows (image, y, x) of its dark pixels. Only decoding a picture into such rows is Python.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .sweep import SMALL, hulls, small_hulls

#: Fixed value: how near segments touch.
TOUCH = 14


def islands(values: DataFrame, keys: list[str], value: str, gap: int) -> DataFrame:
    """Groups of sorted numbers whose neighbours differ by at most gap: keys, island, first, last, n."""
    window = Window.partitionBy(*keys).orderBy(value)
    starts = F.coalesce((F.col(value) - F.lag(value).over(window) > gap).cast("int"), F.lit(0))
    numbered = values.withColumn("_s", starts).withColumn("island", F.sum("_s").over(window))
    return numbered.groupBy(*keys, "island").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("n"))


def runs(pixels: DataFrame) -> DataFrame:
    """Runs of neighbouring dark pixels of a row: image, y, x1, x2."""
    return islands(pixels.select("image", "y", "x").distinct(), ["image", "y"], "x", 1).select("image", "y", F.col("first").alias("x1"), F.col("last").alias("x2"))


def thick(pixels: DataFrame, least: int = 8) -> DataFrame:
    """Dark pixels with at least so many dark ones among the nine around and at them."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    reached = pixels.select("image", "y", "x", F.explode(steps).alias("s")).select("image", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    around = reached.groupBy("image", "y", "x").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return around.join(pixels, ["image", "y", "x"], "left_semi")


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local session without one gets its own."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame) -> DataFrame:
    """df at a shared place, so that rounds don't repeat each other's work."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint()


def held(df: DataFrame, name: str) -> DataFrame:
    """df as packed Parquet at a shared place, read back: what's large and read several times, by some of its columns."""
    folder = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def components(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """nodes(keys, node) with component: the least node reachable over edges(keys, a, b) of the same keys.

    Each round takes the least label among the neighbours and then the label of that label.
    """
    both = _written(edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = _written(nodes.select(*keys, "node", F.col("node").alias("component")))
    while True:
        offered = both.join(labels.select(*keys, F.col("node").alias("b"), "component"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("component").alias("offer"))
        lower = labels.join(offered, [*keys, "node"], "left").select(*keys, "node", "component", F.least("component", F.coalesce("offer", "component")).alias("new"))
        jump = lower.select(*keys, F.col("node").alias("new"), F.col("new").alias("further"))
        new = _written(lower.join(jump, [*keys, "new"], "left").select(*keys, "node", F.col("component").alias("old"), F.least("new", F.coalesce("further", "new")).alias("component")))
        changed = new.filter("old <> component").limit(1).count()
        labels = new.drop("old")
        if not changed:
            return labels


def pixel_components(pixels: DataFrame) -> DataFrame:
    """image, component, size of the four-neighbour components, found over runs instead of pixels."""
    rows = _written(runs(pixels).withColumn("node", F.col("y").cast("long") * 1_000_000 + F.col("x1")))
    below = rows.select("image", (F.col("y") - 1).alias("y"), F.col("x1").alias("b1"), F.col("x2").alias("b2"), F.col("node").alias("b"))
    touching = rows.join(below, ["image", "y"]).filter("x1 <= b2 AND b1 <= x2").select("image", F.col("node").alias("a"), "b")
    of = components(rows.select("image", "node"), touching, ["image"])
    return of.join(rows, ["image", "node"]).groupBy("image", "component").agg(F.sum(F.col("x2") - F.col("x1") + 1).alias("size"))


def crosses(gap: int = TOUCH) -> Column:
    """Whether a horizontal segment (x1, x2, at y1) and a vertical one (v_y1, v_y2, at v_x1) meet within the gap."""
    return F.col("v_x1").between(F.col("x1") - gap, F.col("x2") + gap) & F.col("y1").between(F.col("v_y1") - gap, F.col("v_y2") + gap)


def segment_pairs(segments: DataFrame, gap: int = TOUCH) -> DataFrame:
    """Touching segments of an image: image, a, b. segments: image, node, horizontal, x1, y1, x2, y2."""
    one = segments.filter("horizontal").select("image", F.col("node").alias("a"), "x1", "y1", "x2")
    two = segments.filter("NOT horizontal").select("image", F.col("node").alias("b"), F.col("x1").alias("v_x1"), F.col("y1").alias("v_y1"), F.col("y2").alias("v_y2"))
    across = one.join(two, "image").filter(crosses(gap)).select("image", "a", "b")
    # along the same axis: the place across it, and the start and end along it
    flat = segments.select("image", "node", "horizontal", F.when(F.col("horizontal"), F.col("y1")).otherwise(F.col("x1")).alias("at"), F.when(F.col("horizontal"), F.col("x1")).otherwise(F.col("y1")).alias("s"), F.when(F.col("horizontal"), F.col("x2")).otherwise(F.col("y2")).alias("e"))
    other = flat.select("image", "horizontal", F.col("node").alias("b"), F.col("at").alias("bat"), F.col("s").alias("bs"), F.col("e").alias("be"))
    near = (F.abs(F.col("at") - F.col("bat")) <= gap) & (F.greatest("s", "bs") <= F.least("e", "be") + gap) & (F.col("node") < F.col("b"))
    along = flat.join(other, ["image", "horizontal"]).filter(near).select("image", F.col("node").alias("a"), "b")
    return across.unionByName(along)


def line_components(segments: DataFrame, gap: int = TOUCH) -> DataFrame:
    """Components of touching segments: the least node, the hull, numbers of horizontal and vertical ones and of intersections. The
    segments of an image meet in one row, as its picture does; pages of
    few segments are compared many at once, those of more are swept (see sweep)."""
    kinds = dict(segments.dtypes)
    sides = ("x1", "y1", "x2", "y2")
    one = F.struct(F.col("node").cast("long").alias("node"), "horizontal", *[F.col(c).cast("long").alias(c) for c in sides])
    pages = segments.groupBy("image").agg(F.collect_list(one).alias("s"))
    told = ("component", *sides, "n_horizontal", "n_vertical", "n_crossings")

    struct = pa.struct([(c, pa.int64()) for c in told])

    def swept_page(page: list[dict]) -> list[dict]:
        own = hulls([s["node"] for s in page], [(s["horizontal"], *(s[c] for c in sides)) for s in page], gap)
        return [dict(zip(told, of, strict=True)) for of in own]

    def run(found: pa.Array) -> pa.Array:
        sizes, each = pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64), found.flatten()
        missing = np.zeros(len(each), bool)
        for c in ("node", "horizontal", *sides):
            missing |= pc.is_null(each.field(c)).to_numpy(zero_copy_only=False)
        page = np.repeat(np.arange(len(sizes)), sizes)
        small = (sizes <= SMALL) & (np.bincount(page[missing], minlength=len(sizes)) == 0)
        of = np.flatnonzero(small[page])
        column = lambda c: each.field(c).take(pa.array(of)).to_numpy(zero_copy_only=False)
        per, columns = small_hulls(sizes[small], column("node"), column("horizontal").astype(bool), tuple(column(c) for c in sides), gap)
        parts = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(struct))
        many = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)), pa.int32()), parts)
        if small.all():
            return many
        rest = pa.array([swept_page(p) for p in found.filter(pa.array(~small)).to_pylist()], pa.list_(struct))
        place = np.where(small, np.cumsum(small) - 1, len(many) + np.cumsum(~small) - 1)
        return pa.concat_arrays([many.cast(pa.list_(struct)), rest]).take(pa.array(place))

    swept = arrow_udf(run, "array<struct<" + ", ".join(f"{c}: bigint" for c in told) + ">>")
    out = pages.select("image", F.inline(swept("s")))
    return out.select("image", F.col("component").cast(kinds["node"]).alias("component"), *[F.col(c).cast(kinds[c]).alias(c) for c in sides], "n_horizontal", "n_vertical", "n_crossings")


def table_type(width: Column, height: Column) -> Column:
    """The kind of table that a component is, by its place and shape on the page; null for none.

    Fixed values: the shares of the page and the counts of lines are the rule.
    """
    x1, y1, x2, y2 = F.col("x1") / width, F.col("y1") / height, F.col("x2") / width, F.col("y2") / height
    w, h = x2 - x1, y2 - y1
    area, rows, columns = w * h, F.col("n_horizontal"), F.col("n_vertical")
    grid = (rows + columns >= 8) & (rows >= 2) & (columns >= 2) & (F.col("n_crossings") >= 4)
    shaped = (w >= 0.08) & (h >= 0.015) & (area >= 0.002)
    revision = (x1 >= 0.62) & (y2 <= 0.16) & (h <= 0.085) & (area <= 0.025)
    title = ((y1 >= 0.78) | (y2 >= 0.92)) & (y1 >= 0.62) & (w >= 0.25) & area.between(0.01, 0.32) & (h <= 0.38) & (rows >= 6) & (columns >= 6)
    hole = (x1 <= 0.08) & (x2 <= 0.56) & (y1 <= 0.22) & (h >= 0.18) & (w >= 0.08) & (rows >= 10) & (columns >= 6)
    return F.when(~(grid & shaped), None).when(revision, "revision_table").when(title, "title_or_tolerance_table").when(hole, "hole_table")


def table_confidence() -> Column:
    return F.least(F.lit(0.98), 0.56 + 0.008 * F.least(F.col("n_horizontal") + F.col("n_vertical"), F.lit(40)) + 0.01 * F.least(F.col("n_crossings"), F.lit(10)))


def whiten(pixels: DataFrame, regions: DataFrame) -> DataFrame:
    """The dark pixels outside every region (image, x1, y1, x2, y2; edges included)."""
    inside = (F.col("p.image") == F.col("r.image")) & F.col("p.x").between(F.col("r.x1"), F.col("r.x2")) & F.col("p.y").between(F.col("r.y1"), F.col("r.y2"))
    return pixels.alias("p").join(regions.alias("r"), inside, "left_anti")


