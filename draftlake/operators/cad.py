"""Parameters and scripts for a parametric solid, from what a sample's evidence says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import best_diameter, depth

#: The draft's default sizes in mm, and the diameters preferred in evidence.
DEFAULTS = {"base_length": 50.0, "base_width": 45.0, "hole_pitch_x": 38.0, "hole_pitch_y": 30.0, "chamfer_size": 2.0}
BASE_DEPTH_MARK, BASE_DEPTH = "29", 29.0
THROUGH_DIAMETERS, BORE_DIAMETERS, BORE_DEPTH = (5.5, 4.5, 3.4), (8.0, 6.0), 4.6


def parameters(samples: DataFrame) -> DataFrame:
    """samples(sample_id, dims array<struct<normalized, value>>, evidence array<string>) with the nine parameters.

    The depth of the base is the value of the first dimension whose text holds BASE_DEPTH_MARK and that has one; diameters and
    the bore's depth come from all evidence of the sample.
    """
    marked = F.get(F.filter("dims", lambda d: F.contains(d["normalized"], F.lit(BASE_DEPTH_MARK)) & d["value"].isNotNull()), F.lit(0))
    said = F.array_join("evidence", " | ")
    return samples.withColumns({
        **{k: F.lit(v) for k, v in DEFAULTS.items()},
        "base_depth": F.coalesce(marked["value"].cast("double"), F.lit(BASE_DEPTH)),
        "through_hole_diameter": best_diameter(said, THROUGH_DIAMETERS),
        "counterbore_diameter": best_diameter(said, BORE_DIAMETERS),
        "counterbore_depth": depth(said, BORE_DEPTH),
    })


def _number(value: Column) -> Column:
    return F.call_function("format_number", value, F.lit("0.0###"))


def script(with_parameters: DataFrame) -> DataFrame:
    """The parameters (and counterbores, chamfers: the features' counts) with script: a base, its holes on a grid, chamfers
    where the sample has them, threads as metadata, and the export beside the script."""
    at = lambda sx, sy: F.concat(F.lit("("), _number(sx * F.col("hole_pitch_x") / 2), F.lit(", "), _number(sy * F.col("hole_pitch_y") / 2), F.lit(")"))
    grid = F.concat(F.lit("hole_points = ["), F.concat_ws(", ", *[at(x, y) for x in (-1, 1) for y in (-1, 1)]), F.lit("]"))
    names = ["base_length", "base_width", "base_depth", "hole_pitch_x", "hole_pitch_y", "through_hole_diameter", "counterbore_diameter", "counterbore_depth", "chamfer_size"]
    hole = F.when(F.col("counterbores") > 0, F.lit(".cboreHole(through_hole_diameter, counterbore_diameter, counterbore_depth)")).otherwise(F.lit(".hole(through_hole_diameter)"))
    lines = [
        F.lit("from pathlib import Path\n\nimport cadquery as cq\n"),
        F.concat(F.lit("# Draft for "), F.col("sample_id").cast("string"), F.lit(". REVIEW REQUIRED: the parameters are candidates.")),
        *[F.concat(F.lit(f"{n} = "), _number(F.col(n))) for n in names],
        grid,
        F.lit('result = cq.Workplane("XY").box(base_length, base_width, base_depth)'),
        F.concat(F.lit('result = result.faces(">Z").workplane().pushPoints(hole_points)'), hole),
        F.when(F.col("chamfers") > 0, F.lit("if chamfer_size > 0:\n    result = result.edges('|Z').chamfer(chamfer_size)")),
        F.lit('thread_metadata = {"status": "not_geometrically_modeled"}'),
        F.concat(F.lit('output_path = Path(__file__).with_name("'), F.col("sample_id").cast("string"), F.lit('_cadquery_draft.step")')),
        F.lit("cq.exporters.export(result, str(output_path))"),
    ]
    return with_parameters.withColumn("script", F.concat(F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n")))


def tile_grid(sizes: DataFrame, most: int = 12) -> DataFrame:
    """sizes(id, width, height) with the grid of at most ``most`` tiles whose aspect comes closest; among equals
    the later one, in order of tiles, if the image has room for half of it."""
    grids = sizes.sparkSession.range(1, most + 1).select(F.col("id").cast("int").alias("cols")).withColumn("rows", F.explode(F.sequence(F.lit(1), F.floor(F.lit(most) / F.col("cols")).cast("int"))))
    each = sizes.crossJoin(F.broadcast(grids)).withColumn("gap", F.abs(F.col("width") / F.col("height") - F.col("cols") / F.col("rows")))  # a grid list of fixed length
    closest = each.groupBy("id", "width", "height").agg(F.min("gap").alias("least"), F.collect_list(F.struct((F.col("cols") * F.col("rows")).alias("tiles"), "cols", "rows", "gap")).alias("all"))
    equal = F.array_sort(F.filter("all", lambda g: g["gap"] == F.col("least")))
    fits = F.filter(equal, lambda g: F.col("width") * F.col("height") > 0.5 * 448 * 448 * g["tiles"])
    chosen = F.coalesce(F.try_element_at(fits, F.lit(-1)), F.get(equal, F.lit(0)))
    return closest.select("id", "width", "height", chosen["cols"].alias("cols"), chosen["rows"].alias("rows"))
