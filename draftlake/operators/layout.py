"""Layout regions of a page from its line segments, or from its picture (``regions_of_pictures``).

segments: image, node, horizontal, x1, y1, x2, y2; pages: image, width, height. Each detector returns image,
region_type, x1, y1, x2, y2, confidence, keep_crop; ``regions`` unites them in their fixed order, numbers them and
drops repeated boxes (numbers stay as they were given, so they can have gaps).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, hull, numbered
from . import pictures as P
from .raster import _written, islands, line_components, table_confidence, table_type

#: Shares of the page, pixels, and confidences of the detectors.
EDGE, LONG, BORDER_PAD = 0.025, 0.35, 12
INNER_LIMIT, INNER_LENGTH, INNER_GAP, INNER_PAD = 0.08, 0.60, 8, 18
FRAME_EDGE, FRAME_LENGTH = 0.04, 0.75
TABLE_PAD, CORNER_PAD = 22, 14
BAND_TOP, OVERLAP = 0.62, 0.35
CONFIDENCE = {"page_border": 0.95, "inner_frame_strip": 0.88, "corner_metadata_box": 0.82, "technical_requirements": 0.78}
COLUMNS = ["image", "region_type", *Box._fields, "confidence", "keep_crop"]


def _region(kind: str, box: Box, confidence: Column | None = None, keep: bool = True) -> list[Column]:
    sure = F.lit(CONFIDENCE[kind]) if confidence is None else confidence
    return [F.col("image"), F.lit(kind).alias("region_type"), *[c.cast("int").alias(n) for c, n in zip(box, Box._fields, strict=True)], sure.alias("confidence"), F.lit(keep).alias("keep_crop")]


def _share(of: str, ratio: float) -> Column:
    """A share of a side in whole pixels, cut."""
    return (F.col(of) * ratio).cast("int")


def _length() -> Column:
    return F.when(F.col("horizontal"), F.col("x2") - F.col("x1")).otherwise(F.col("y2") - F.col("y1"))


def borders(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """One strip for each edge of the page that a long line runs along."""
    on = segments.join(pages, "image").withColumn("_long", _length() >= F.when(F.col("horizontal"), _share("width", LONG)).otherwise(_share("height", LONG))).filter("_long")
    near = {
        "top": F.col("horizontal") & (F.col("y1") <= _share("height", EDGE)),
        "bottom": F.col("horizontal") & (F.col("y1") >= F.col("height") - _share("height", EDGE)),
        "left": ~F.col("horizontal") & (F.col("x1") <= _share("width", EDGE)),
        "right": ~F.col("horizontal") & (F.col("x1") >= F.col("width") - _share("width", EDGE)),
    }
    reach = on.groupBy("image", "width", "height").agg(
        F.max(F.when(near["top"], F.col("y2"))).alias("top"), F.min(F.when(near["bottom"], F.col("y1"))).alias("bottom"), F.max(F.when(near["left"], F.col("x2"))).alias("left"), F.min(F.when(near["right"], F.col("x1"))).alias("right")
    )
    zero, w, h = F.lit(0), F.col("width"), F.col("height")
    strips = {
        "top": Box(zero, zero, w, F.least(h, F.col("top") + BORDER_PAD)), "bottom": Box(zero, F.greatest(zero, F.col("bottom") - BORDER_PAD), w, h),
        "left": Box(zero, zero, F.least(w, F.col("left") + BORDER_PAD), h), "right": Box(F.greatest(zero, F.col("right") - BORDER_PAD), zero, w, h),
    }
    each = F.array(*[F.when(F.col(edge).isNotNull(), F.struct(*[c.cast("int").alias(n) for c, n in zip(box, Box._fields, strict=True)], F.lit(i).alias("part"))) for i, (edge, box) in enumerate(strips.items())])
    found = reach.select("image", F.inline(F.array_compact(each)))  # one pass, not one for each edge
    return found.select(*_region("page_border", Box.of(), keep=False), "part")


def inner_frames(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """Strips around long upright lines a little inside the page's left and right edge."""
    outer, inner = _share("width", EDGE), _share("width", INNER_LIMIT)
    long = segments.filter("NOT horizontal").join(pages, "image").filter(_length() >= _share("height", INNER_LENGTH))
    side = F.when((F.col("x1") > outer) & (F.col("x1") <= inner), 0).when((F.col("x1") >= F.col("width") - inner) & (F.col("x1") < F.col("width") - outer), 1)
    sided = long.withColumn("side", side).filter("side IS NOT NULL")
    groups = islands(sided.select("image", "side", "x1").distinct(), ["image", "side"], "x1", INNER_GAP).select("image", "side", "island", "first", "last")
    members = sided.join(groups, ["image", "side"]).filter("x1 BETWEEN first AND last")
    boxes = members.groupBy("image", "side", "island", "width", "height").agg(*hull())
    return boxes.select(*_region("inner_frame_strip", Box.of().padded(INNER_PAD, F.col("width"), F.col("height")), keep=False), (F.col("side") * 1000 + F.col("island")).alias("part"))


def without_frame(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """The segments that aren't the page's own frame."""
    across, along = F.when(F.col("horizontal"), F.col("height")).otherwise(F.col("width")), F.when(F.col("horizontal"), F.col("width")).otherwise(F.col("height"))
    margin = (across * FRAME_EDGE).cast("int")
    first, last = F.when(F.col("horizontal"), F.col("y1")).otherwise(F.col("x1")), F.when(F.col("horizontal"), F.col("y2")).otherwise(F.col("x2"))
    frame = (_length() >= along * FRAME_LENGTH) & ((first <= margin) | (last >= across - margin))
    return segments.join(pages, "image").filter(~frame).select(*segments.columns)


def tables(components: DataFrame, pages: DataFrame) -> DataFrame:
    """Components (raster.line_components) that are tables by their shape and place."""
    on = components.join(pages, "image")
    kind = table_type(F.col("width"), F.col("height"))
    padded = Box.of().padded(TABLE_PAD, F.col("width"), F.col("height"))
    return on.withColumn("_kind", kind).filter("_kind IS NOT NULL").select("image", F.col("_kind").alias("region_type"), *[c.cast("int").alias(n) for c, n in zip(padded, Box._fields, strict=True)], table_confidence().alias("confidence"), F.lit(True).alias("keep_crop"), F.col("component").alias("part"))


def bottom_bands(components: DataFrame, pages: DataFrame) -> DataFrame:
    """Title tables among the components of the segments in the lower part of the page."""
    box = Box.of()
    w, h, area = box.width() / F.col("width"), box.height() / F.col("height"), box.area() / (F.col("width") * F.col("height"))
    rows, columns, met = F.col("n_horizontal"), F.col("n_vertical"), F.col("n_crossings")
    grid = (rows >= 4) & (columns >= 4) & (rows + columns >= 8) & (met >= 4)
    placed = (F.col("y1") / F.col("height") >= BAND_TOP) & (F.col("y2") / F.col("height") >= 0.92) & (w >= 0.25) & (h <= 0.38) & area.between(0.01, 0.32)
    sure = F.least(F.lit(0.96), 0.62 + 0.008 * F.least(rows + columns, F.lit(35)) + 0.008 * F.least(met, F.lit(10)))
    return components.join(pages, "image").filter(grid & placed).select(*_region("title_or_tolerance_table", box.padded(TABLE_PAD, F.col("width"), F.col("height")), sure), F.col("component").alias("part"))


def lower_segments(segments: DataFrame, pages: DataFrame) -> DataFrame:
    return segments.join(pages, "image").filter(F.col("y1") >= _share("height", BAND_TOP)).select(*segments.columns)


def corner_boxes(components: DataFrame, pages: DataFrame) -> DataFrame:
    """Small boxes in the upper corners, with the size of their page: what corners chooses from."""
    box = Box.of()
    w, h, area = box.width() / F.col("width"), box.height() / F.col("height"), box.area() / (F.col("width") * F.col("height"))
    cornered = (F.col("y1") / F.col("height") <= 0.16) & ((F.col("x1") / F.col("width") <= 0.22) | (F.col("x2") / F.col("width") >= 0.78))
    shaped = w.between(0.015, 0.28) & h.between(0.006, 0.10) & (area <= 0.025)
    found = components.join(pages, "image").filter(cornered & shaped & (F.col("n_horizontal") >= 2) & (F.col("n_vertical") >= 2) & (F.col("n_crossings") >= 2))
    return found.select("image", *Box._fields, "component", "width", "height")


def corners(found: DataFrame, known: DataFrame) -> DataFrame:
    """The small boxes in the upper corners that no known region but a border covers."""
    box = Box.of()
    others = known.filter("region_type <> 'page_border'").select("image", *[F.col(c).alias(f"k_{c}") for c in Box._fields])
    covered = found.join(others, "image").filter(box.coverage_by(Box.of("k_")) >= OVERLAP).select("image", "component").distinct()
    free = found.join(covered, ["image", "component"], "left_anti")
    return free.select(*_region("corner_metadata_box", box.padded(CORNER_PAD, F.col("width"), F.col("height"))), F.col("component").alias("part"))


def notes(islands_: DataFrame, pages: DataFrame, rules: P.PictureRules = P.PictureRules()) -> DataFrame:
    """The written notes of a page: the hull of the islands (pictures.text_islands) that begin near its left edge, in columns wide enough,
    high enough and with enough ink."""
    on = islands_.join(pages, "image").filter(
        (F.col("total") >= rules.note_pixels) & (F.col("pixels") >= rules.note_pixels) & (F.col("left") <= _share("width", rules.note_anchor))
        & (F.col("right") - F.col("left") >= _share("width", rules.note_width)) & (F.col("y2") - F.col("y1") >= _share("height", rules.note_height))
    )
    blocks = on.groupBy("image", "width", "height").agg(*hull())
    return blocks.select(*_region("technical_requirements", Box.of().padded(TABLE_PAD, F.col("width"), F.col("height"))), F.lit(0).alias("part"))


def regions(segments: DataFrame, pages: DataFrame, corner_segments: DataFrame | None = None, texts: DataFrame | None = None, rules: P.PictureRules = P.PictureRules()) -> DataFrame:
    """All regions of each page: region_id and the detectors' columns. corner_segments: shorter lines, of which the boxes
    in the corners are made (else the segments); texts: islands of what may be notes."""
    inside = without_frame(segments, pages)
    components = line_components(inside)
    small = components if corner_segments is None else line_components(without_frame(corner_segments, pages))
    before = [borders(segments, pages), tables(components, pages), bottom_bands(line_components(lower_segments(inside, pages)), pages), inner_frames(segments, pages)]
    # a few rows a page, and read twice: written once, with the boxes that may become corners, so that segments are read by one job only
    boxes = corner_boxes(small, pages).withColumnRenamed("component", "part")
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("detector", F.lit(i)) for i, df in enumerate([*before, boxes])])
    found = _written(found)
    known = found.filter(F.col("detector") < len(before)).drop("width", "height")
    boxes = found.filter(F.col("detector") == len(before)).select("image", *Box._fields, F.col("part").alias("component"), "width", "height")
    united = known.unionByName(corners(boxes, known).withColumn("detector", F.lit(len(before))))
    if texts is not None:
        united = united.unionByName(notes(texts, pages, rules).withColumn("detector", F.lit(len(before) + 1)))
    order = Window.partitionBy("image").orderBy("detector", "part", "region_type")
    same = Window.partitionBy("image", "region_type", *Box._fields).orderBy("_n")
    given = united.withColumn("_n", F.row_number().over(order))
    return given.withColumn("_same", F.row_number().over(same)).filter("_same = 1").select(numbered("r", F.col("_n")).alias("region_id"), *COLUMNS)


def regions_of_pictures(pages: DataFrame, rules: P.PictureRules = P.PictureRules()) -> DataFrame:
    """The regions of page pictures (image, data: PNG). Pictures that can't be read have none."""
    found = _written(P.marks(pages, rules))
    sizes = found.filter("kind = 'page' AND width IS NOT NULL").select("image", "width", "height")
    of = lambda kind: found.filter(F.col("kind") == kind).select("image", "node", "horizontal", *Box._fields)
    texts = found.filter("kind = 'text'").select("image", *Box._fields, "left", "right", "pixels", "total")
    return regions(of("line"), sizes, of("corner"), texts, rules)


def clean_pages(pages: DataFrame, rules: P.PictureRules = P.PictureRules()) -> tuple[DataFrame, DataFrame]:
    """(regions, cleaned pictures with their masks) of page pictures."""
    found = _written(regions_of_pictures(pages, rules))
    return found, P.cleaned(pages, found)
