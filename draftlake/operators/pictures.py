"""Page pictures in Arrow batches, one page at a time: line segments, text blocks, crop features, cleaned pages.

Only what needs pixels is Python: a picture comes in as PNG bytes and leaves as a few rows (or as a new picture); all
rules on them are DataFrame operators (``layout``, ``detections``). pictures: image, data (PNG, 8 bits a channel).
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Weights of red, green and blue in grey (of 65,536); set cells of nine that make a thick place.
GREY, THICK = (19595, 38470, 7471), 8
#: One, in the resampler's weights.
FIXED = 1 << 22


@dataclass(frozen=True)
class PictureRules:
    """What counts as ink, how long lines are, where notes stand, how crops are measured."""

    dark: int = 190
    neutral: int = 36
    line_share: float = 0.025
    line_least: int = 64
    corner_shares: tuple[float, float] = (0.015, 0.006)
    corner_least: tuple[int, int] = (12, 8)
    note_top: float = 0.68
    note_bottom_margin: float = 0.025
    note_right: float = 0.45
    note_anchor: float = 0.18
    note_width: float = 0.04
    note_height: float = 0.035
    note_gaps: tuple[int, int] = (140, 70)
    note_longest: float = 0.12
    note_pixels: int = 80
    crop_dark: int = 180
    crop_side: int = 640


def decode_png(data: bytes) -> np.ndarray:
    """height x width x 3; an alpha channel is left out. ValueError for what isn't an 8-bit, non-interlaced PNG."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, body, palette = 8, [], None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    if depth != 8 or laced or colour not in _CHANNELS:
        raise ValueError(f"PNG of {depth} bits, colour type {colour}, interlaced {laced}")
    n = _CHANNELS[colour]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * n)
    out, above = lines[:, 1:], np.zeros(width * n, np.uint8)
    if lines[:, 0].any():
        out = np.empty((height, width * n), np.uint8)
        for y, line in enumerate(lines):
            out[y] = above = _unfiltered(int(line[0]), line[1:], above, n)
    pixels = out.reshape(height, width, n)
    if colour == 3:
        return palette[pixels[:, :, 0]]
    return _of_grey(pixels[:, :, 0]) if n < 3 else pixels[:, :, :3]


def _of_grey(plane: np.ndarray) -> np.ndarray:
    """A grey plane as three equal channels, kept once (read-only)."""
    return np.broadcast_to(plane[:, :, None], (*plane.shape, 3))


def _is_grey(pixels: np.ndarray) -> bool:
    return pixels.ndim == 3 and pixels.strides[2] == 0


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, n), axis=0, dtype=np.uint8).reshape(-1)
    if kind == 2:
        return line + above
    out, up = line.tolist(), above.tolist()  # each byte needs the one before it
    for i, value in enumerate(out):
        a, b, c = (out[i - n], up[i], up[i - n]) if i >= n else (0, up[i], 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        out[i] = (value + guess) & 255
    return np.array(out, np.uint8)


def encode_png(pixels: np.ndarray) -> bytes:
    """Of height x width (grey) or height x width x 3 bytes."""
    height, width = pixels.shape[:2]
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(pixels, np.uint8).reshape(height, -1)], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def extremes(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The brightest and the darkest channel of each pixel."""
    if _is_grey(pixels):
        return pixels[:, :, 0], pixels[:, :, 0]
    red, green, blue = (pixels[:, :, i] for i in range(3))
    return np.maximum(np.maximum(red, green), blue), np.minimum(np.minimum(red, green), blue)


def ink(pixels: np.ndarray, rules: PictureRules = PictureRules()) -> np.ndarray:
    """Dark pixels without much colour."""
    most, least = extremes(pixels)
    return (most < rules.dark) & (most - least <= rules.neutral) if not _is_grey(pixels) else (most < rules.dark) & (rules.neutral >= 0)


def long_runs(mask: np.ndarray, least: int) -> np.ndarray:
    """(row, first, end) of the runs of at least so many set cells in the rows of mask."""
    width = mask.shape[1]
    at = np.flatnonzero(mask)  # pages are mostly white
    if not len(at):
        return np.zeros((0, 3), np.int64)
    breaks = np.flatnonzero((np.diff(at) != 1) | (at[1:] % width == 0))
    first, end = at[np.append(0, breaks + 1)], at[np.append(breaks, len(at) - 1)] + 1
    keep = end - first >= least
    rows = first[keep] // width
    return np.stack([rows, first[keep] - rows * width, end[keep] - rows * width], axis=1)


def segments(mask: np.ndarray, across: int, down: int) -> list[tuple[bool, int, int, int, int]]:
    """(horizontal, x1, y1, x2, y2) of the lines of at least so many pixels."""
    return _lines(long_runs(mask, across), long_runs(np.ascontiguousarray(mask.T), down), across, down)


def _lines(flat: np.ndarray, upright: np.ndarray, across: int, down: int) -> list[tuple[bool, int, int, int, int]]:
    """The segments of runs of rows and of columns that are long enough."""
    flat, upright = flat[flat[:, 2] - flat[:, 1] >= across], upright[upright[:, 2] - upright[:, 1] >= down]
    return [(True, x1, y, x2, y + 1) for y, x1, x2 in flat.tolist()] + [(False, x, y1, x + 1, y2) for x, y1, y2 in upright.tolist()]


def _without_long_runs(mask: np.ndarray, least: int) -> np.ndarray:
    found = long_runs(mask, least)
    if not len(found):
        return mask
    steps = np.zeros((mask.shape[0], mask.shape[1] + 1), np.int32)
    np.add.at(steps, (found[:, 0], found[:, 1]), 1)
    np.add.at(steps, (found[:, 0], found[:, 2]), -1)
    return mask & ~(np.cumsum(steps, axis=1)[:, :-1] > 0)


def _islands(at: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """(first, end) of groups of sorted places whose neighbours are at most gap apart."""
    cuts = np.flatnonzero(np.diff(at) > gap)
    return list(zip(at[np.append(0, cuts + 1)].tolist(), (at[np.append(cuts, len(at) - 1)] + 1).tolist(), strict=True)) if len(at) else []


def sums(mask: np.ndarray) -> np.ndarray:
    """The summed-area table of a mask: set cells above and left of each corner of the cells."""
    table = np.zeros((mask.shape[0] + 1, mask.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(mask, axis=0, dtype=np.int64), axis=1, out=table[1:, 1:])
    return table


def inside(table: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> int:
    """Set cells of a box, by four look-ups; sides beyond the page count as its edge."""
    (y1, y2), (x1, x2) = np.clip((y1, y2), 0, table.shape[0] - 1), np.clip((x1, x2), 0, table.shape[1] - 1)
    return int(table[y2, x2] - table[y1, x2] - table[y2, x1] + table[y1, x1]) if x2 > x1 and y2 > y1 else 0


def text_islands(mask: np.ndarray, rules: PictureRules = PictureRules()) -> list[tuple[int, ...]]:
    """What may be lines of writing in the lower left of a page, long lines left out: (x1, y1, x2, y2: the hull of an
    island of rows within an island of columns; first and end of these columns; set pixels in it; set pixels in all)."""
    height, width = mask.shape
    top, corner = int(height * rules.note_top), mask[int(height * rules.note_top) : height - int(height * rules.note_bottom_margin), : int(width * rules.note_right)]
    if not corner.any():
        return []
    longest = [max(12, int(side * rules.note_longest)) for side in (width, height)]
    table = sums(_without_long_runs(_without_long_runs(corner, longest[0]).T, longest[1]).T)
    found, total = [], int(table[-1, -1])
    for left, right in _islands(np.flatnonzero(np.diff(table[-1]) >= 2), rules.note_gaps[0]):
        in_rows = np.diff(table[:, right] - table[:, left])
        for y1, y2 in _islands(np.flatnonzero(in_rows >= 2), rules.note_gaps[1]):
            in_columns = np.flatnonzero(np.diff(table[y2, left : right + 1] - table[y1, left : right + 1]))
            found.append((left + int(in_columns[0]), top + y1, left + int(in_columns[-1]) + 1, top + y2, left, right, inside(table, left, y1, right, y2), total))
    return found


def _read(data: bytes | dict | None) -> np.ndarray | None:
    """RGB pixels of a PNG, or of what Spark's image reader has decoded (BGR); None if it can't be read."""
    if isinstance(data, dict):
        height, width, channels = data["height"], data["width"], data["nChannels"]
        if height < 1 or width < 1:
            return None
        pixels = np.frombuffer(data["data"], np.uint8).reshape(height, width, channels)
        return np.repeat(pixels, 3, axis=2) if channels == 1 else np.ascontiguousarray(pixels[:, :, 2::-1])
    try:
        return decode_png(bytes(data)) if data is not None else None
    except (ValueError, KeyError, struct.error, zlib.error, UnboundLocalError):
        return None


MARKS = "width int, height int, kind string, node long, horizontal boolean, x1 int, y1 int, x2 int, y2 int, left int, right int, pixels int, total int"


def marks(pictures: DataFrame, rules: PictureRules = PictureRules()) -> DataFrame:
    """What a page's rules are judged on: rows of kind page (its size; null if the picture can't be read), line, corner
    (shorter lines, for the boxes in the corners) and text (islands of what may be writing, with their columns left to right, their
    pixels and those of all)."""

    def of(image, data: bytes | None) -> list[tuple]:
        if (pixels := _read(data)) is None:
            return [(image, None, None, "page", 0, *[None] * 9)]
        mask = ink(pixels, rules)
        height, width = mask.shape
        long = [max(rules.line_least, int(side * rules.line_share)) for side in (width, height)]
        short = [max(least, int(side * share)) for least, side, share in zip(rules.corner_least, (width, height), rules.corner_shares, strict=True)]
        runs = [long_runs(m, min(of)) for m, of in zip((mask, np.ascontiguousarray(mask.T)), zip(long, short, strict=True), strict=True)]
        lines, corners = _lines(*runs, *long), _lines(*runs, *short)
        found = [("page", None, 0, 0, width, height), *(("line", *s) for s in lines), *(("corner", *s) for s in corners)]
        rows = [(image, width, height, kind, i, *rest, *[None] * 4) for i, (kind, *rest) in enumerate(found)]
        return rows + [(image, width, height, "text", len(found) + i, None, *island) for i, island in enumerate(text_islands(mask, rules))]

    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    named = [c.split() for c in MARKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("image", batch.schema.field("image").type), *((c, kinds[kind]) for c, kind in named)])
            for image, data in zip(*(batch.column(c).to_pylist() if c == "image" else batch.column(c) for c in ("image", "data")), strict=True):
                columns = zip(*of(image, data.as_py()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return pictures.select("image", "data").mapInArrow(run, f"image {dict(pictures.dtypes)['image']}, {MARKS}")


def _part_sizes(mask: np.ndarray) -> np.ndarray:
    """Sizes of the four-neighbour components, by runs."""
    runs = long_runs(mask, 1)
    if not len(runs):
        return np.zeros(0, np.int64)
    width = mask.shape[1] + 1
    first, end = runs[:, 0] * width + runs[:, 1], runs[:, 0] * width + runs[:, 2]
    # runs of the row below that overlap: they end after this one begins, and begin before it ends
    low, high = np.searchsorted(end, first + width, "right"), np.searchsorted(first, end + width, "left")
    many = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(runs)), many)
    b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    label = np.arange(len(runs))
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return np.bincount(label, end - first)[np.unique(label)].astype(np.int64)


def fitted(width: int, height: int, most: int) -> tuple[int, int]:
    """The size of a picture shrunk to a longest side, its shape kept as nearly as whole numbers allow."""
    if max(width, height) <= most:
        return width, height
    shape, by_width = width / height, width >= height
    exact = most / shape if by_width else most * shape
    other = min((math.floor(exact), math.ceil(exact)), key=lambda n: abs(shape - (most / n if by_width else n / most)) if n else math.inf)
    return (most, max(other, 1)) if by_width else (max(other, 1), most)


def _cubic(x: np.ndarray) -> np.ndarray:
    """Keys' convolution kernel with a = -1/2."""
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


def _weights(old: int, new: int, begin: float, end: float) -> tuple[np.ndarray, np.ndarray]:
    """(cells, fixed-point weights) of each new cell of a side, with the kernel stretched over what it stands for."""
    scale = (end - begin) / new
    stretch = max(scale, 1.0)
    centre = begin + (np.arange(new) + 0.5) * scale
    low = np.maximum((centre - 2 * stretch + 0.5).astype(np.int64), 0)
    high = np.minimum((centre + 2 * stretch + 0.5).astype(np.int64), old)
    cells = low[:, None] + np.arange((high - low).max())
    weights = np.where(cells < high[:, None], _cubic((cells - centre[:, None] + 0.5) / stretch), 0.0)
    return np.minimum(cells, old - 1), np.round(weights / weights.sum(axis=1, keepdims=True) * FIXED).astype(np.int64)


def _along(grey: np.ndarray, cells: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows of grey resampled; rounded to whole levels."""
    out = np.full((len(grey), len(cells)), FIXED // 2, np.int64)
    for k in range(cells.shape[1]):
        out += grey[:, cells[:, k]] * weights[:, k]
    return np.clip(out // FIXED, 0, 255)


def shrunk(grey: np.ndarray, most: int) -> np.ndarray:
    """A grey picture with a longest side of at most so many cells: whole cells averaged as long as it's four times too large or more, then
    a separable cubic convolution, across first. Pictures that fit stay as they are."""
    height, width = grey.shape
    new_width, new_height = fitted(width, height, most)
    if (new_width, new_height) == (width, height):
        return grey
    by = [max(int(old / new / 2), 1) for old, new in ((height, new_height), (width, new_width))]
    if max(by) > 1:
        rows, columns = np.arange(0, height, by[0]), np.arange(0, width, by[1])
        area = np.outer(np.diff(np.append(rows, height)), np.diff(np.append(columns, width)))
        grey = (np.add.reduceat(np.add.reduceat(grey, rows, axis=0), columns, axis=1) * 2 + area) // (2 * area)
    grey = _along(grey, *_weights(grey.shape[1], new_width, 0.0, width / by[1]))
    return _along(grey.T, *_weights(grey.shape[0], new_height, 0.0, height / by[0])).T


def measure_crop(pixels: np.ndarray, box: tuple[int, int, int, int], rules: PictureRules = PictureRules()) -> tuple[float, float, float, int]:
    """(ink, thick, largest: shares of the crop; components) of what a box cuts from a page, shrunk to crop_side if larger."""
    (x1, x2), (y1, y2) = (np.sort(np.clip(box[i::2], 0, pixels.shape[1 - i])) for i in (0, 1))
    crop = pixels[y1:y2, x1:x2].astype(np.int64)
    if not crop.size:
        return 0.0, 0.0, 0.0, 0
    dark = shrunk((crop @ np.array(GREY) + (1 << 15)) >> 16, rules.crop_side) < rules.crop_dark
    table = sums(np.pad(dark, 1))
    around = table[3:, 3:] - table[:-3, 3:] - table[3:, :-3] + table[:-3, :-3]
    sizes = _part_sizes(dark)
    share = lambda n: round(int(n) / dark.size, 6)
    return share(dark.sum()), share((dark & (around >= THICK)).sum()), share(sizes.max(initial=0)), len(sizes)


def with_colour(regions: DataFrame, pictures: DataFrame, rules: PictureRules = PictureRules()) -> DataFrame:
    """regions (image, x1, y1, x2, y2) with coloured: the share of a region's dark pixels that have a colour, 0 without dark ones, null
    without a picture. A page is summed up once, whatever its regions; they come to it as one array."""
    from pyspark.sql import functions as F
    from pyspark.sql.functions import arrow_udf

    sides = ("x1", "y1", "x2", "y2")
    boxes = regions.groupBy("image").agg(F.collect_set(F.struct(*[F.col(c).cast("long").alias(c) for c in sides])).alias("boxes"))

    def run(data: pa.Array, of: pa.Array) -> pa.Array:
        out = []
        for value, own in zip(data.to_pylist(), of.to_pylist(), strict=True):
            if (pixels := _read(value)) is None:
                out.append([])
                continue
            most, least = extremes(pixels)
            dark = sums(most < rules.dark)
            colour = sums((most < rules.dark) & (most - least > rules.neutral))
            shares = [(b, inside(dark, *(b[c] for c in sides)), inside(colour, *(b[c] for c in sides))) for b in own if None not in b.values()]
            out.append([{**b, "coloured": round(c / d, 6) if d else 0.0} for b, d, c in shares])
        return pa.array(out, pa.list_(pa.struct([*((c, pa.int64()) for c in sides), ("coloured", pa.float64())])))

    measured = arrow_udf(run, "array<struct<" + ", ".join(f"{c}: bigint" for c in sides) + ", coloured: double>>")
    told = pictures.select("image", "data").join(boxes.hint("merge"), "image").select("image", F.inline(measured("data", "boxes")))
    return regions.drop("coloured").join(told, ["image", *sides], "left").select(*[c for c in regions.columns if c != "coloured"], "coloured")


def _spread(pictures: DataFrame) -> DataFrame:
    """pictures in as many partitions as the session's exchanges have: white pages are a few bytes, but work, and would be coalesced to a few tasks. After
    what they're joined with, whose own exchange would deal them out anew."""
    return pictures.repartition(int(pictures.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_features(detections: DataFrame, pictures: DataFrame, keys: list[str], rules: PictureRules = PictureRules()) -> DataFrame:
    """detections with features, page_width and page_height of their page's picture; null where there's none or it
    can't be read, and then the size stays what the detections say (0 if nothing). pictures: keys, data.

    The boxes of a page go to its picture as one array, so a picture is moved and read once; what comes back is numbers. There's an
    array for each page, so they meet by sorting, however small they're thought to be: broadcast, they'd have to fit into the driver.
    """
    from pyspark.sql import functions as F

    boxes = detections.groupBy(*keys).agg(F.collect_list(F.struct("ord", "x1", "y1", "x2", "y2")).alias("boxes"))
    kinds = dict(detections.dtypes)
    found = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", ord {kinds['ord']}, features struct<ink: double, thick: double, largest: double, components: int>, seen_width int, seen_height int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                if (pixels := _read(row["data"])) is None:
                    continue
                out = []
                for b in row["boxes"]:
                    # pandas makes floating point numbers of sides beside a missing one
                    sides = [None if b[c] is None or b[c] != b[c] else int(b[c]) for c in ("x1", "y1", "x2", "y2")]
                    features = None if None in sides else dict(zip(("ink", "thick", "largest", "components"), measure_crop(pixels, tuple(sides), rules), strict=True))
                    out.append((*(row[k] for k in keys), b["ord"], features, pixels.shape[1], pixels.shape[0]))
                yield pd.DataFrame(out, columns=[*keys, "ord", "features", "seen_width", "seen_height"])

    measured = _spread(pictures.select(*keys, "data").join(boxes.hint("merge"), keys)).mapInPandas(run, found)
    own = [c for c in ("page_width", "page_height") if c in detections.columns]
    joined = detections.drop("features").join(measured, [*keys, "ord"], "left")
    size = lambda seen, said: F.coalesce(seen, F.col(said) if said in own else F.lit(None), F.lit(0)).cast("int").alias(said)
    others = [c for c in detections.columns if c not in ("features", "page_width", "page_height")]
    return joined.select(*others, "features", size(F.col("seen_width"), "page_width"), size(F.col("seen_height"), "page_height"))


def cleaned(pictures: DataFrame, regions: DataFrame) -> DataFrame:
    """pictures with clean (the regions painted white, edges included) and mask (white where they are), as PNG. regions:
    image, x1, y1, x2, y2 of those to remove; a page without any stays as it is."""
    from pyspark.sql import functions as F

    boxes = regions.groupBy("image").agg(F.collect_list(F.array("x1", "y1", "x2", "y2")).alias("boxes"))
    joined = _spread(pictures.select("image", "data").join(boxes.hint("merge"), "image", "left"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image, data, own in zip(batch["image"], batch["data"], batch["boxes"], strict=True):
                if (pixels := _read(data)) is None:
                    continue
                clean, mask = (pixels[:, :, 0] if _is_grey(pixels) else pixels).copy(), np.zeros(pixels.shape[:2], np.uint8)
                for x1, y1, x2, y2 in own if own is not None else []:
                    if x2 > x1 and y2 > y1:
                        clean[y1 : y2 + 1, x1 : x2 + 1], mask[y1 : y2 + 1, x1 : x2 + 1] = 255, 255
                yield pd.DataFrame({"image": [image], "clean": [encode_png(clean)], "mask": [encode_png(mask)]})

    return joined.mapInPandas(run, f"image {dict(pictures.dtypes)['image']}, clean binary, mask binary")
