"""Pictures: decoding, detectors on drawn pages, crop features."""

import math
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftlake.operators import detections, layout, pictures
from draftlake.plans import drawn
from draftlake.sources import files

WIDTH, HEIGHT, PEN = 1000, 700, 2


class Sheet:
    """A page with ink, and what's to be found on it."""

    def __init__(self, seed):
        self.rng = np.random.default_rng(seed)
        self.pixels = np.full((HEIGHT, WIDTH, 3), 255, np.uint8)
        self.regions = set()

    def between(self, low, high):
        return int(self.rng.integers(low, high + 1))

    def level(self, x1, x2, y, pen=PEN):
        self.pixels[y : y + pen, x1:x2] = 0

    def upright(self, x, y1, y2, pen=PEN):
        self.pixels[y1:y2, x : x + pen] = 0

    def net(self, x1, y1, x2, y2, rows, columns):
        """Lines of a table; its hull."""
        for y in np.linspace(y1, y2, rows + 1).astype(int):
            self.level(x1, x2 + PEN, y)
        for x in np.linspace(x1, x2, columns + 1).astype(int):
            self.upright(x, y1, y2 + PEN)
        return x1, y1, x2 + PEN, y2 + PEN

    def expect(self, kind, hull, pad):
        self.regions.add((kind, max(hull[0] - pad, 0), max(hull[1] - pad, 0), min(hull[2] + pad, WIDTH), min(hull[3] + pad, HEIGHT)))

    def view(self):
        """A drawing in the middle, which is no region."""
        x, y = self.between(250, 330), self.between(200, 260)
        self.net(x, y, x + self.between(150, 250), y + self.between(90, 150), 1, 1)
        return self

    def title(self):
        hull = self.net(self.between(400, 560), self.between(550, 590), self.between(850, 960), self.between(655, 680), self.between(3, 6), self.between(3, 8))
        self.expect("title_or_tolerance_table", hull, 22)
        return self

    def holes(self):
        hull = self.net(self.between(40, 75), self.between(60, 140), self.between(200, 240), self.between(320, 400), self.between(5, 8), self.between(3, 5))
        self.expect("hole_table", hull, 22)
        return self

    def corner(self):
        hull = self.net(self.between(800, 830), self.between(30, 45), self.between(900, 950), self.between(70, 88), 1, self.between(2, 3))
        self.expect("corner_metadata_box", hull, 14)
        return self

    def frame(self):
        for x in (self.between(40, 60), self.between(935, 955)):
            y1, y2, pen = self.between(40, 60), self.between(630, 660), self.between(1, 4)
            self.upright(x, y1, y2, pen)
            self.expect("inner_frame_strip", (x, y1, x + pen, y2), 18)
        return self

    def writing(self):
        x, y, across, down = self.between(40, 120), self.between(500, 530), self.between(6, 14), self.between(3, 6)
        for i in range(down):
            for j in range(across):
                self.pixels[y + 18 * i : y + 18 * i + 9, x + 14 * j : x + 14 * j + 7] = 0
        self.expect("technical_requirements", (x, y, x + 14 * across - 7, y + 18 * down - 9), 22)
        return self

    def stamp(self):
        """Coloured ink is no line."""
        x, y = self.between(400, 700), self.between(100, 400)
        self.pixels[y : y + 60, x : x + 200] = (self.between(60, 180), 0, 0)
        return self


SHEETS = {
    "title": Sheet.title, "holes": Sheet.holes, "corner": Sheet.corner, "frame": Sheet.frame, "writing": Sheet.writing, "nothing": lambda s: s,
    "several": lambda s: s.title().corner().holes(), "notes": lambda s: s.writing().title(),
}


def sheets():
    return {f"{name}{seed}": make(Sheet(seed)).view().stamp() for name, make in SHEETS.items() for seed in range(3)}


def test_regions_of_random_pages(spark):
    drawn_ = sheets()
    rows = [(name, bytearray(pictures.encode_png(s.pixels))) for name, s in drawn_.items()] + [("broken", bytearray(b"x")), ("none", None)]
    pages = spark.createDataFrame(rows, "image string, data binary")
    found = {name: set() for name in drawn_}
    for r in layout.regions_of_pictures(pages).collect():
        found[r.image].add((r.region_type, r.x1, r.y1, r.x2, r.y2))
        assert r.keep_crop == (r.region_type != "inner_frame_strip")
    assert found == {name: s.regions for name, s in drawn_.items()}
    assert layout.regions_of_pictures(pages.limit(0)).count() == 0


def test_pages_that_sparks_reader_has_decoded(spark, tmp_path):
    some = {name: s for name, s in sheets().items() if name.endswith("0")}
    for i, (name, s) in enumerate(some.items()):
        (tmp_path / name).mkdir()
        (tmp_path / name / "page_001_600dpi.png").write_bytes(filtered(s.pixels[:, :, :], [i % 5]) if i < 2 else pictures.encode_png(s.pixels))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "page_001_600dpi.png").write_bytes(b"nothing")
    read = files.page_pictures(spark, str(tmp_path), 600)
    found = {name: set() for name in some}
    for r in layout.regions_of_pictures(read.select(F.col("sample_id").alias("image"), "data")).collect():
        found[r.image].add((r.region_type, r.x1, r.y1, r.x2, r.y2))
    assert found == {name: s.regions for name, s in some.items()}


def test_cleaned_pages_are_white_where_regions_are(spark):
    sheet, other = Sheet(5).title().view(), Sheet(6).view()
    pages = spark.createDataFrame([("a", bytearray(pictures.encode_png(sheet.pixels))), ("b", bytearray(pictures.encode_png(other.pixels)))], "image string, data binary")
    regions, cleaned = layout.clean_pages(pages)
    assert {r.image for r in regions.collect()} == {"a"}
    rows = {r.image: r for r in cleaned.collect()}
    clean, mask = pictures.decode_png(bytes(rows["a"].clean)), pictures.decode_png(bytes(rows["a"].mask))
    want = np.zeros((HEIGHT, WIDTH), bool)
    for _, x1, y1, x2, y2 in sheet.regions:
        want[y1 : y2 + 1, x1 : x2 + 1] = True
    assert (clean[want] == 255).all() and (clean[~want] == sheet.pixels[~want]).all() and ((mask[:, :, 0] == 255) == want).all()
    assert (pictures.decode_png(bytes(rows["b"].clean)) == other.pixels).all()


def test_a_large_page_of_writing_takes_little(spark):
    """6000 x 4000 pixels with as many short lines as letters have."""
    rng = np.random.default_rng(4)
    page = np.full((4000, 6000), 255, np.uint8)
    for y in range(100, 3900, 26):
        for x in rng.integers(60, 5800, 60):
            page[y : y + 3, x : x + int(rng.integers(90, 180))] = 0
    pages = spark.createDataFrame([("p", bytearray(pictures.encode_png(page)))], "image string, data binary")
    began = time.perf_counter()
    layout.regions_of_pictures(pages).collect()
    assert time.perf_counter() - began < 60


def test_colour_of_regions_and_sums(spark):
    rng = np.random.default_rng(8)
    page = rng.integers(0, 256, (40, 50, 3), dtype=np.uint8)
    boxes = [tuple(int(v) for v in (*rng.integers(-5, 50, 2), *rng.integers(-5, 60, 2))) for _ in range(50)] + [(0, 0, 50, 40)]
    regions = spark.createDataFrame([("p", *b, "own") for b in boxes] + [("q", 0, 0, 1, 1, "own"), ("p", None, 0, 1, 1, "own")], "image string, x1 int, y1 int, x2 int, y2 int, coloured string")
    got = pictures.with_colour(regions, spark.createDataFrame([("p", bytearray(pictures.encode_png(page)))], "image string, data binary")).collect()
    most, least = page.max(axis=2).astype(int), page.min(axis=2).astype(int)
    for r in got:
        if r.image == "q" or r.x1 is None:
            assert r.coloured is None
            continue
        part = (slice(max(r.y1, 0), max(r.y2, 0)), slice(max(r.x1, 0), max(r.x2, 0)))
        dark = most[part] < 190
        assert r.coloured == (round((dark & (most[part] - least[part] > 36)).sum() / dark.sum(), 6) if dark.any() else 0.0)
    assert len(got) == len(boxes) + 2


def filtered(pixels, kinds):
    """A PNG of RGB pixels whose lines are filtered by the given kinds, as the format defines them."""
    height, width = pixels.shape[:2]
    flat = pixels.reshape(height, -1).astype(int)
    lines = []
    for y in range(height):
        out = []
        for i in range(width * 3):
            a = flat[y, i - 3] if i >= 3 else 0
            b = flat[y - 1, i] if y else 0
            c = flat[y - 1, i - 3] if y and i >= 3 else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            guess = [0, a, b, (a + b) // 2, near][kinds[y % len(kinds)]]
            out.append((flat[y, i] - guess) % 256)
        lines.append(bytes([kinds[y % len(kinds)], *out]))
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_png_round_trip_and_all_line_filters():
    rng = np.random.default_rng(1)
    page = rng.integers(0, 256, (12, 17, 3), dtype=np.uint8)
    assert (pictures.decode_png(pictures.encode_png(page)) == page).all()
    assert (pictures.decode_png(pictures.encode_png(page[:, :, 0]))[:, :, 1] == page[:, :, 0]).all()
    for kinds in ([0], [1], [2], [3], [4], [0, 1, 2, 3, 4]):
        assert (pictures.decode_png(filtered(page, kinds)) == page).all()
    with pytest.raises(ValueError, match="not a PNG"):
        pictures.decode_png(b"GIF89a")


def components(mask):
    """Sizes of four-neighbour components by flooding."""
    left, sizes = set(zip(*np.nonzero(mask), strict=True)), []
    while left:
        todo, size = [left.pop()], 0
        while todo:
            y, x = todo.pop()
            size += 1
            for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        sizes.append(size)
    return sorted(sizes)


def test_crop_measures_equal_plain_counts():
    rng = np.random.default_rng(3)
    for share in (0.0, 0.3, 0.6, 1.0):
        mask = rng.random((23, 31)) < share
        page = np.where(mask[:, :, None], 0, 255).astype(np.uint8).repeat(3, axis=2)
        assert sorted(pictures._part_sizes(mask).tolist()) == components(mask)
        ink, thick, largest, parts = pictures.measure_crop(page, (-5, -5, 99, 99))
        full = sum(bool(mask[y, x]) and mask[max(y - 1, 0) : y + 2, max(x - 1, 0) : x + 2].sum() >= 8 for y in range(23) for x in range(31))
        assert (ink, thick, largest, parts) == (round(mask.sum() / mask.size, 6), round(full / mask.size, 6), round(max(components(mask), default=0) / mask.size, 6), len(components(mask)))
    assert pictures.measure_crop(page, (5, 5, 5, 9)) == (0.0, 0.0, 0.0, 0)
    assert pictures.measure_crop(np.zeros((900, 900, 3), np.uint8), (0, 0, 900, 900)) == (1.0, round(638 * 638 / 640**2, 6), 1.0, 1)


@pytest.mark.parametrize(("size", "want"), [((640, 640), (640, 640)), ((641, 10), (640, 10)), ((1280, 961), (640, 481)), ((961, 1280), (480, 640)), ((5000, 3), (640, 1)), ((1000, 701), (640, 449)), ((30, 40), (30, 40))])
def test_size_of_shrunk_crops(size, want):
    assert pictures.fitted(*size, 640) == want


def exactly(grey, new, begin, end):
    """Rows resampled by the stretched cubic kernel in exact weights, levels not rounded."""
    scale = (end - begin) / new
    out = np.zeros((len(grey), new))
    for i in range(new):
        centre = begin + (i + 0.5) * scale
        low, high = max(int(centre - 2 * scale + 0.5), 0), min(int(centre + 2 * scale + 0.5), grey.shape[1])
        x = [abs((k - centre + 0.5) / scale) for k in range(low, high)]
        w = np.array([1.5 * v**3 - 2.5 * v**2 + 1 if v < 1 else -0.5 * v**3 + 2.5 * v**2 - 4 * v + 2 if v < 2 else 0 for v in x])
        out[:, i] = grey[:, low:high] @ (w / math.fsum(w))
    return np.clip(out, 0, 255)


@pytest.mark.parametrize("size", [(641, 500), (700, 900), (1300, 640)])
def test_shrunk_crops_are_within_a_level_of_exact_weights(size):
    """Weights of 22 bits and levels rounded after each direction: at most one level off what exact arithmetic gives."""
    grey = np.random.default_rng(2).integers(0, 256, size[::-1]).astype(np.int64)
    width, height = pictures.fitted(*size, 640)
    want = exactly(exactly(grey, width, 0, size[0]).T, height, 0, size[1]).T
    got = pictures.shrunk(grey, 640)
    assert got.shape == want.shape and np.abs(got - want).max() <= 1.25 and np.abs(got - want).mean() < 0.4
    assert (pictures.shrunk(np.full((3000, 4000), 77), 640) == 77).all() and pictures.shrunk(np.zeros((4000, 6000), np.int64), 640).shape == (427, 640)


def test_filter_uses_what_crops_look_like(spark):
    page = np.full((400, 400), 255, np.uint8)
    page[20:80, 20:80] = 0
    for i in range(4):
        page[120 + 20 * i, 20:90] = 0
    rows = [(1, 1, 0, 10, 10, 100, 100, 0.9), (1, 1, 1, 10, 110, 110, 210, 0.2), (1, 1, 2, 300, 300, 390, 390, 0.2), (2, 1, 0, 10, 10, 100, 100, 0.9), (1, 1, 3, None, 0, 1, 1, 0.9)]
    found = spark.createDataFrame(rows, "sample_id long, page int, ord int, x1 int, y1 int, x2 int, y2 int, score double").withColumn("view_id", F.lit("v"))
    pages = spark.createDataFrame([(1, 1, bytearray(pictures.encode_png(page))), (2, 1, bytearray(b"?"))], "sample_id long, page int, data binary")
    nothing = spark.createDataFrame([], "sample_id long, page int, ord int, region_type string, x1 int, y1 int, x2 int, y2 int")
    featured = pictures.with_features(found, pages, ["sample_id", "page"])
    got = {(r.sample_id, r.ord): (r.reject_reason, r.page_width) for r in detections.decide(featured, nothing).collect()}
    assert got == {(1, 0): ("dense_text_or_stamp", 400), (1, 1): (None, 400), (1, 2): ("below_min_score", 400), (2, 0): (None, 0), (1, 3): ("invalid_bbox", 400)}


def test_drawn_pages_are_of_every_kind():
    assert {drawn.draw(k, 0).shape for k in range(drawn.KINDS)} == {(700, 1000), (1200, 1000)}


def test_grey_pages_are_kept_once_and_stay_grey():
    """A grey picture isn't blown up to three planes."""
    plane = np.arange(60, dtype=np.uint8).reshape(6, 10)
    pixels = pictures.decode_png(pictures.encode_png(plane))
    assert pixels.shape == (6, 10, 3) and pixels.strides[2] == 0 and (pixels == plane[:, :, None]).all()


def test_pages_are_spread_for_their_work(spark):
    """Small pictures aren't coalesced to one task before they're read."""
    white = pictures.encode_png(np.full((20, 20), 255, np.uint8))
    pages = spark.createDataFrame([(i, bytearray(white)) for i in range(40)], "image long, data binary")
    boxes = spark.createDataFrame([(i, 1, 1, 5, 5) for i in range(40)], "image long, x1 int, y1 int, x2 int, y2 int")
    cleaned = pictures.cleaned(pages, boxes).select("image", F.spark_partition_id().alias("at"))
    assert len({r["at"] for r in cleaned.collect()}) > 1


def test_arrays_of_pages_are_not_broadcast(spark, tmp_path):
    """There are as many as pages, whatever a plan takes their size for."""
    spark.range(40).selectExpr("id AS sample_id", "1 AS page", "0 AS ord", "'v' AS view_id", "0 AS x1", "0 AS y1", "9 AS x2", "9 AS y2", "0.9D AS score", "10 AS page_height").write.parquet(f"{tmp_path}/found")
    found = spark.read.parquet(f"{tmp_path}/found")
    regions = found.select("sample_id", "page", "ord", F.lit("hole_table").alias("region_type"), "x1", "y1", "x2", "y2")
    pages = found.select("sample_id", "page", F.lit(pictures.encode_png(np.full((10, 10), 255, np.uint8))).alias("data"))
    of_image = lambda df: df.withColumnRenamed("sample_id", "image").drop("page")
    for df, reads in (
        (detections.decide(found, regions), "Project"), (pictures.with_features(found, pages, ["sample_id", "page"]), "MapInPandas"),
        (pictures.cleaned(of_image(pages), of_image(found)), "MapInPandas"), (pictures.with_colour(of_image(found), of_image(pages)), "ArrowEvalPython"),
    ):
        met = df._jdf.queryExecution().executedPlan().toString().split(reads, 1)[1]  # what's below the reading of pictures
        assert "Broadcast" not in met and df.count() == 40


def test_pages_stay_spread_whatever_their_keys(spark):
    """A page that's always 1 isn't dealt out by, and another exchange by sample would be coalesced."""
    pages = spark.range(40).selectExpr("id AS sample_id", "1 AS page").withColumn("data", F.lit(pictures.encode_png(np.full((20, 20), 255, np.uint8))))
    found = spark.range(40).selectExpr("id AS sample_id", "1 AS page", "0 AS ord", "1 AS x1", "1 AS y1", "5 AS x2", "5 AS y2")
    plan = pictures.with_features(found, pages, ["sample_id", "page"])._jdf.queryExecution().executedPlan().toString()
    below = plan.split("MapInPandas", 1)[1].splitlines()[1]
    assert "Exchange RoundRobin" in below
