"""Operators on small drawn-up cases."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftlake.functions import documents, geometry, text
from draftlake.functions.geometry import Box
from draftlake.operators import cad, detections, drawing, features, layout, raster, scoring, views
from draftlake.plans import stage
from draftlake.sources import files, sinks
from draftlake.streaming import incremental

DETECTION = "sample_id string, page int, ord int, view_id string, x1 int, y1 int, x2 int, y2 int, score double, page_width int, page_height int"
LAYOUT = "sample_id string, page int, ord int, region_type string, x1 int, y1 int, x2 int, y2 int"


def reasons(spark, rows, regions=(), **more):
    found = spark.createDataFrame(rows, DETECTION)
    for name, column in more.items():
        found = found.withColumn(name, column)
    return {(r.sample_id, r.ord): r.reject_reason for r in detections.decide(found, spark.createDataFrame(list(regions), LAYOUT)).collect()}


def test_strips_and_scores(spark):
    rows = [
        ("A", 1, 1, "view_001", 120, 20, 880, 90, 0.37, 1000, 1000), ("A", 1, 2, "view_002", 150, 230, 850, 360, 0.55, 1000, 1000), ("A", 1, 3, "view_003", 150, 230, 850, 360, 0.05, 1000, 1000),
        ("A", 1, 4, "view_004", 150, 230, 850, 360, 0.3, 1000, 1000), ("A", 1, 5, "view_005", 150, 230, 150, 360, 0.9, 1000, 1000), ("A", 1, 6, None, None, 0, 1, 1, 0.9, 1000, 1000),
    ]
    got = reasons(spark, rows)
    assert [got["A", i] for i in range(1, 7)] == ["top_strip_low_score", None, "below_hard_min_score", "below_min_score", "invalid_bbox", "invalid_bbox"]


def test_layout_overlap_takes_the_first_region(spark):
    rows = [("C", 1, 1, "v", 520, 590, 780, 760, 0.92, 800, 800)]
    regions = [("C", 1, 2, "hole_table", 500, 560, 790, 780), ("C", 1, 1, "title_or_tolerance_table", 500, 560, 790, 780), ("C", 1, 0, "page_border", 0, 0, 800, 800)]
    assert reasons(spark, rows, regions) == {("C", 1): "layout_region_overlap:title_or_tolerance_table"}


def test_features_reject_stamps_and_rescue_drawings(spark):
    rows = [("A", 1, 1, "a", 150, 230, 850, 360, 0.22, 1000, 1000), ("A", 1, 2, "b", 720, 760, 940, 910, 0.66, 1000, 1000)]
    value = lambda *v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("ink", "thick", "largest", "components"), strict=True)])
    got = reasons(spark, rows, features=F.when(F.col("ord") == 1, value(0.05, 0.0, 0.02, 4)).otherwise(value(0.5, 0.4, 0.3, 1)))
    assert got == {("A", 1): None, ("A", 2): "dense_text_or_stamp"}


def test_accepted_views_are_renumbered(spark):
    rows = [("A", 1, i, f"view_{i:03d}", 0, 300, 400, 600, s, 1000, 1000) for i, s in ((1, 0.1), (2, 0.9), (3, 0.2), (9, 0.8))]
    decided = detections.decide(spark.createDataFrame(rows, DETECTION), spark.createDataFrame([], LAYOUT))
    assert [(r.view_id, r.source_view_id) for r in detections.accepted(decided).orderBy("ord").collect()] == [("view_001", "view_002"), ("view_002", "view_009")]
    assert detections.summary(decided).first().asDict() == {"input_count": 4, "accepted_count": 2, "rejected_count": 2, "page_count": 1}


VIEW = "sample_id string, ord int, view_id string, x1 int, y1 int, x2 int, y2 int, page_width int, page_height int"


def test_views_are_classified_by_place(spark):
    boxes = [(100, 100, 700, 300), (740, 120, 820, 330), (120, 340, 690, 390), (680, 430, 930, 620)]
    df = spark.createDataFrame([("P", i, f"view_{i:03d}", *b, 1000, 700) for i, b in enumerate(boxes)], VIEW)
    got = views.classify(df).orderBy("ord").collect()
    assert [r.view_type for r in got] == ["front", "left", "top", "isometric"]
    assert got[0].is_primary and not got[0].needs_review and got[3].needs_review


def test_crops_without_detection_are_skipped(spark):
    crops = [("R", 1, "view_001", 100, 100, 700, 300), ("R", 2, "view_002", 120, 360, 690, 420), ("R", 3, "view_003", 790, 510, 930, 620), ("S", 1, "view_001", 0, 0, 9, 9), ("T", 1, "view_001", 0, 0, 9, 9)]
    df = spark.createDataFrame([(*c, 1000, 700) for c in crops], VIEW)
    known = spark.createDataFrame([("R", 1, "a", 100, 100, 700, 300), ("R", 2, "b", 120, 360, 690, 420)], "sample_id string, ord int, view_id string, x1 int, y1 int, x2 int, y2 int")
    kept, skipped = views.split_by_detections(df, known, spark.createDataFrame([("R",), ("T",)], "sample_id string"))
    assert {(r.sample_id, r.view_id) for r in kept.collect()} == {("R", "view_001"), ("R", "view_002"), ("S", "view_001")}
    assert {(r.sample_id, r.view_id) for r in skipped.collect()} == {("R", "view_003"), ("T", "view_001")}


def test_audit_reasons(spark):
    seen = spark.createDataFrame([("A", 2, 1), ("B", 2, 0)], "sample_id string, detected long, rejected long")
    crops = spark.createDataFrame([("A", 2, 2, 2), ("B", 1, 1, 1), ("B-copy", 2, 2, 1)], "sample_id string, exported long, with_metadata long, with_image long")
    audited = views.audit(seen, crops)
    got = {r.sample_id: r for r in audited.collect()}
    assert got["A"].is_consistent and got["A"].reasons == []
    assert got["B"].reasons == ["view_count_mismatch"]
    assert got["B-copy"].reasons == ["copy_sample", "missing_view_detection", "missing_clean_view_image"]
    assert views.audit_summary(audited).first().asDict() == {"total": 3, "consistent": 1, "to_review": 2, "copies": 1}


def test_boxes(spark):
    row = spark.range(1).select(
        geometry.rounded_box(F.parse_json(F.lit('["1.5", 2.5, 3, "4"]'))).alias("a"), geometry.rounded_box(F.parse_json(F.lit("[1, 2, 3]"))).alias("b"), geometry.rounded_box(F.parse_json(F.lit('[1, 2, 3, "x"]'))).alias("c"),
        geometry.rounded_box(F.parse_json(F.lit("[1, 2, 3, 1e300]"))).alias("d"), geometry.cut_box(F.array(*[F.lit(x) for x in (1.9, -1.9, 3.0, 4.0)])).alias("e"), Box(*map(F.lit, (0, 0, 10, 10))).share_of_smaller(Box(*map(F.lit, (5, 5, 9, 9)))).alias("s"),
        Box(*map(F.lit, (0, 0, 10, 10))).coverage_by(Box(*map(F.lit, (5, 5, 9, 9)))).alias("c2"), geometry.copy_name(F.lit("x Copy 2")).alias("n"), geometry.sizes([F.lit(0), F.lit(7)]).alias("z"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.s, row.c2, row.n, row.z) == ([2, 2, 3, 4], None, None, None, [1, -1, 3, 4], 1.0, 0.16, True, 7)


@pytest.mark.parametrize(("given", "quantity", "value"), [("4-M3", 4, 3.0), ("4 x Φ4.5", 4, 4.5), ("29.00 ±0.05", None, 29.0), ("1.2.3", None, None), ("12×7", 12, 7.0), ("", None, None)])
def test_dimension_texts(spark, given, quantity, value):
    row = spark.range(1).select(text.leading_quantity(F.lit(given)).alias("q"), text.dimension_value(F.lit(given)).alias("v")).first()
    assert (row.q, row.v) == (quantity, value)


def test_diameters_and_depths(spark):
    row = spark.range(1).select(
        text.normalised_dimension(F.lit("\t ⌀ 5 h7 ")).alias("n"), text.best_diameter(F.lit("Φ4.5 Φ8"), (5.5, 4.5)).alias("p"), text.best_diameter(F.lit("Φ7"), (5.5, 4.5)).alias("f"), text.best_diameter(F.lit("none"), (5.5, 4.5)).alias("d"),
        text.depth(F.lit("深 4.2"), 1.0).alias("h"), text.depth(F.lit("x"), 1.0).alias("o"), text.mentions_thread(F.array(F.lit("45mm"))).alias("m"),
    ).first()
    assert tuple(row) == ("Φ5H7", 4.5, 7.0, 5.5, 4.2, 1.0, True)


def test_scripts_are_sanitised(spark):
    fence = "`" * 3
    given = [f"Sure:\n{fence}python\nfrom cq import *\nresult = 1\nexport(result)\n{fence}\n", "from __future__ import annotations\nx.export(1)", "import cadquery as cq\na = 1\n\n"]
    got = [r.s for r in spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, t string").orderBy("i").select(text.sanitised_script(F.col("t")).alias("s")).collect()]
    assert got == ["import cadquery as cq\nresult = 1\ncq.exporters.export(result)\n", "from __future__ import annotations\nimport cadquery as cq\nx.export(1)\n", "import cadquery as cq\na = 1\n"]


def test_json(spark):
    given = ['{"a": 1}', '﻿ {"a": 1} ', '{"a": 1}{}', "{", None, 'text {"a": {"b": 2}} end', "[1]"]
    df = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", documents.strict_json("t").alias("s"), documents.json_in_text("t").alias("j")).orderBy("i").collect()
    assert [r.s.document for r in df] == ['{"a": 1}', '{"a": 1}', None, None, None, None, "[1]"]
    assert "Trailing data" in df[2].s.error
    assert [r.j for r in df] == ['{"a": 1}', '{"a": 1}', None, None, None, '{"a": {"b": 2}}', "[1]"]


def test_drawing_documents_are_validated(spark):
    rows = [("A", 1, '{"sample_id": "A", "page": 1, "image_size": {"w": 1}, "views": []}'), ("A", 1, '{"sample_id": "B", "page": 1}'), ("A", 1, "{}x"), ("A", 1, '{"sample_id": "A", "page": 1, "image_size": [1], "views": []}'), ("A", 1, "[]")]
    got = [r.error for r in drawing.validate(spark.createDataFrame(rows, "sample_id string, page int, text string")).collect()]
    assert got[0] is None and got[1] == "sample_id does not match" and got[2].startswith("Trailing data") and got[3] == "image_size is not an object" and got[4] == "document is not an object"


def test_stage_results(spark):
    rows = spark.createDataFrame([("a", None), ("b", "bad")], "k string, error string")
    result = stage.split(rows, ["k"])
    assert [r.k for r in result.result.collect()] == ["a"]
    assert stage.counts(result.status).first().asDict() == {"total": 2, "done": 1, "failed": 1}
    with pytest.raises(Exception, match="bad"):
        stage.split(rows, ["k"], fail_fast=True).status.collect()


PREDICTION = "sample_id string, ord long, task string, model string, dimensions array<struct<text string, normalized string>>, feature_counts map<string,int>, evidence array<string>"


def test_predictions_become_a_plan(spark):
    rows = [
        ("S", 1, "dimension_ocr", "m", [("4-M3", ""), ("4-M3", ""), ("29", None), ("", "x")], None, None),
        ("S", 2, "feature_count", "m", None, {"through_hole": 4, "slot": 0}, ["b", "a", "b"]),
        ("S", 3, "feature_count", "n", None, {"through_hole": 2, "counterbore": 4}, ["c", "a"]),
    ]
    given = spark.createDataFrame(rows, PREDICTION)
    dims = features.dimensions(given)
    assert [(r.id, r.text, r.quantity, r.value) for r in dims.orderBy("id").collect()] == [("d001", "4-M3", 4, 3.0), ("d002", "29", None, 29.0)]
    found = features.candidates(given)
    assert [(r.id, r.type, r["count"], r.sources, r.evidence, r.status) for r in found.orderBy("id").collect()] == [
        ("f001", "counterbore", 4, ["n"], ["c", "a"], "candidate"), ("f002", "slot", 0, [], [], "not_detected"), ("f003", "through_hole", 4, ["m", "n"], ["b", "a", "c"], "candidate"),
    ]
    steps = [(r.id, r.operation) for r in features.plan(given, found, dims).orderBy("id").collect()]
    assert steps == [("op001", "create_base_solid"), ("op002", "cut_through_hole_pattern"), ("op003", "cut_counterbore_or_spotface_pattern"), ("op004", "represent_threaded_holes")]


def test_scores(spark):
    df = spark.createDataFrame([(["Φ5", "5"], ["φ5", "7"], {"a": 1}, {"a": 1, "b": 0}), ([], [], {}, {}), (["x"], [], {"a": 1}, {"a": 2})], "p array<string>, t array<string>, c map<string,int>, d map<string,int>")
    got = df.select(scoring.token_f1(F.col("p"), F.col("t")).alias("f"), scoring.count_accuracy(F.col("c"), F.col("d")).alias("a")).collect()
    assert [(r.f, r.a) for r in got] == [(0.5, 1.0), (1.0, 1.0), (0.0, 0.0)]
    empty = scoring.metrics(spark.createDataFrame([], "valid boolean, score double")).first()
    assert (empty.num_records, empty.json_parse_rate, empty.mean_score) == (0, 0.0, None)


def test_draft_parameters(spark):
    # the text's first number isn't the value; the bore's diameter stands beside another feature; U has evidence of a bore
    # but counts none
    rows = [("S", [("4-M29", None), ("29", 29.5)], ["8 x Φ5.5", "Φ8 深4.6"], 4, 4), ("T", [], [], 0, 0), ("U", [("4-M29", 3.0)], ["Φ8 深5"], 0, 0)]
    given = spark.createDataFrame(rows, "sample_id string, dims array<struct<normalized string, value double>>, evidence array<string>, counterbores int, chamfers int")
    rows = {r.sample_id: r for r in cad.script(cad.parameters(given)).collect()}
    s = rows["S"]
    assert (s.base_depth, s.through_hole_diameter, s.counterbore_diameter, s.counterbore_depth) == (29.5, 5.5, 8.0, 4.6)
    u = rows["U"]
    assert (u.base_depth, u.through_hole_diameter, u.counterbore_depth) == (3.0, 8.0, 5.0) and ".hole(" in u.script
    assert rows["T"].base_depth == 29.0 and "cq.exporters.export" in s.script and "thread_metadata" in s.script
    assert ".cboreHole(" in s.script and ".chamfer(" in s.script and ".cboreHole(" not in rows["T"].script
    compile(s.script, "script", "exec")


def draw(boxes, lines=()):
    page = np.zeros((60, 80), bool)
    for x1, y1, x2, y2 in boxes:
        page[y1 : y2 + 1, x1 : x2 + 1] = True
    return page


def test_rasters_as_rows(spark):
    page = draw([(2, 2, 20, 2), (2, 2, 2, 30), (40, 10, 44, 14), (45, 15, 45, 15)])
    pixels = spark.createDataFrame([(1, int(y), int(x)) for y, x in np.argwhere(page)], "image long, y int, x int")
    assert raster.runs(pixels).filter("y = 2").first()[2:] == (2, 20)
    sizes = sorted(r["size"] for r in raster.pixel_components(pixels).collect())
    assert sizes == [1, 25, 47]
    assert raster.thick(pixels).count() == 9
    left = raster.whiten(pixels, spark.createDataFrame([(1, 0, 0, 30, 40)], "image long, x1 int, y1 int, x2 int, y2 int"))
    assert left.count() == 26


def test_tables_from_segments(spark):
    rows = [(1, i, True, 30, 560 + 12 * i, 960, 560 + 12 * i) for i in range(11)] + [(1, 100 + i, False, 30 + 186 * i, 560, 30 + 186 * i, 680) for i in range(6)] + [(1, 300, True, 10, 20, 60, 20)]
    segments = spark.createDataFrame(rows, "image long, node int, horizontal boolean, x1 int, y1 int, x2 int, y2 int")
    found = raster.line_components(segments).withColumn("type", raster.table_type(F.lit(1000), F.lit(700))).withColumn("confidence", raster.table_confidence()).orderBy("component").collect()
    assert [(r.type, r.n_horizontal, r.n_vertical, r.n_crossings) for r in found] == [("title_or_tolerance_table", 11, 6, 66), (None, 1, 0, 0)]


SEGMENT = "image long, node int, horizontal boolean, x1 int, y1 int, x2 int, y2 int"


def test_layout_regions(spark):
    def box(first, x1, y1, x2, y2):
        return [(first, True, x1, y1, x2, y1), (first + 1, True, x1, y2, x2, y2), (first + 2, False, x1, y1, x1, y2), (first + 3, False, x2, y1, x2, y2)]

    table = [(100 + i, True, 30, 560 + 12 * i, 960, 560 + 12 * i) for i in range(11)] + [(150 + i, False, 30 + 186 * i, 560, 30 + 186 * i, 680) for i in range(6)]
    strips = [(200 + i, False, x, 42, x, 500) for i, x in enumerate((57, 58, 59))]
    corner = [*box(300, 780, 30, 960, 88), (310, False, 840, 30, 840, 88)]
    frame = [(400, True, 5, 10, 990, 10)]
    rows = [(1, *r) for r in table + strips + corner + frame + box(500, 300, 200, 600, 400)]
    found = layout.regions(spark.createDataFrame(rows, SEGMENT), spark.createDataFrame([(1, 1000, 700)], "image long, width int, height int")).orderBy("region_id").collect()
    got = [(r.region_id, r.region_type, r.x1, r.y1, r.x2, r.y2) for r in found]
    assert got == [
        ("r001", "page_border", 0, 0, 1000, 22), ("r002", "title_or_tolerance_table", 8, 538, 982, 700), ("r004", "inner_frame_strip", 39, 24, 77, 518), ("r005", "corner_metadata_box", 766, 16, 974, 102),
    ]


def test_listings(spark, tmp_path):
    for name in ("A/page_001_600dpi.png", "A/page_001_300dpi.png", "B/page_002_600dpi.png", "B/note.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    paths = files.listing(spark, str(tmp_path))
    assert [(r.sample_id, r.page) for r in files.rendered_pages(paths, 600).collect()] == [("A", 1), ("B", 2)]
    given = spark.createDataFrame([("d/A/page_1_views.json",), ("d/A/page_1_views_raw.json",), ("d/B/page_002_views.json",), ("d/B/page_002_rejected_views.json",)], "path string")
    assert {(r.sample_id, r.page, r.name) for r in files.detection_inputs(given).collect()} == {("A", 1, "page_1_views_raw.json"), ("B", 2, "page_002_views.json")}
    pairs = files.pair_index(spark.createDataFrame([("r/X.pdf",), ("r/x.STP",), ("r/y.pdf",)], "path string")).orderBy("sample_id").collect()
    assert [(r.sample_id, r.step_path) for r in pairs] == [("X", "r/x.STP"), ("y", None)]
    folders = files.view_folders(spark.createDataFrame([("s/P/view_001/view_metadata.json",), ("s/P/view_x/view_metadata.json",)], "path string"), spark.createDataFrame([], "path string"))
    assert [tuple(r) for r in folders.collect()] == [("P", "view_001", False)]
    row = spark.range(1).select(files.sample_of_pdf(F.lit("/data/raw/a/b.c.pdf"), "/data/raw").alias("s"), files.page_of_name(F.lit("x_page_012.png")).alias("p")).first()
    assert tuple(row) == ("a__b.c", 12)


def test_reports_and_documents(spark, tmp_path):
    df = spark.createDataFrame([("a", True, ["x", "y"], None)], "k string, ok boolean, why array<string>, none string")
    sinks.write_report(df, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).collect()[1].value.startswith("a,True,x;y,")
    sinks.write_documents(df, str(tmp_path / "d"))
    sinks.append_documents(df, str(tmp_path / "d"))
    assert [r.value for r in spark.read.text(str(tmp_path / "d")).collect()] == ['{"k":"a","ok":true,"why":["x","y"],"none":null}'] * 2
    (tmp_path / "s.csv").write_text("sample_id,pdf_path,step_path,level,part_family,notes\né,a.pdf, ,,,\n")
    assert tuple(files.samples_csv(spark, str(tmp_path / "s.csv")).first()) == ("é", "a.pdf", None, "", "", "")


def test_stream_filters_each_file_once(spark, tmp_path):
    rows = [("A", 1, 1, "v", 0, 300, 400, 600, 0.9, 1000, 1000), ("A", 1, 2, "w", 0, 300, 400, 600, 0.1, 1000, 1000)]
    df, layout = spark.createDataFrame(rows, DETECTION), spark.createDataFrame([], LAYOUT)
    run = lambda: incremental.filter_new_detections(spark, str(tmp_path / "in"), DETECTION, layout, str(tmp_path / "out"), str(tmp_path / "state"))
    for _ in range(2):
        df.write.mode("append").parquet(str(tmp_path / "in"))
        run()
    run()
    assert spark.read.parquet(str(tmp_path / "out/accepted")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out/rejected")).count() == 2


def test_detector_meets_views_by_sample_only(spark):
    box = "x1 int, y1 int, x2 int, y2 int"
    seen = spark.createDataFrame([("R", 1, "a", 100, 100, 700, 300), ("R", 2, "b", 0, 0, 10, 10), ("S", 1, "a", 0, 0, 9, 9), (None, 1, "a", 0, 0, 9, 9)], f"sample_id string, ord int, view_id string, {box}")
    found = spark.createDataFrame([("R", 2, "d2", "s2", 0.7, 100, 100, 700, 300), ("R", 1, "d1", "s1", 0.9, 100, 100, 700, 300)], f"sample_id string, ord int, view_id string, source_view_id string, score double, {box}")
    metadata = spark.createDataFrame([("R", "a", 0.1), ("R", "a", 0.2), ("S", "a", 0.3)], "sample_id string, view_id string, meta_score double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    told = drawing.with_detector(seen, found, metadata)
    keys = re.findall(r"hashpartitioning\((.*?), \d+\)", told._jdf.queryExecution().executedPlan().toString())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert keys and all(re.fullmatch(r"sample_id#\d+", k) for k in keys)
    rows = [(r.sample_id, r.ord, r.match_ord, r.detected_view_id, r.source_view_id, r.meta_score, r.final_score, r.error) for r in told.collect()]
    missing, alone = "missing view metadata", "does not match any accepted detection"
    right = [("R", 1, 1, "d1", "s1", 0.1, 0.9, None), ("R", 1, 1, "d1", "s1", 0.2, 0.9, None), ("R", 2, None, None, None, None, None, missing), ("S", 1, None, None, None, 0.3, 0.3, alone), (None, 1, None, None, None, None, None, missing)]
    assert sorted(rows, key=str) == sorted(right, key=str)
    own = drawing.with_detector(views.with_match(seen, found, told_of=drawing.DETECTOR), found, metadata)
    assert sorted(map(str, own.select(*told.columns).collect())) == sorted(map(str, told.collect()))
