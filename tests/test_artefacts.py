"""Files of a run out and in again, and the samples that their paths name."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import udf

from draftlake.operators import mentions
from draftlake.sources import artefacts, files, sinks


def files_under(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(root) for n in names}


def test_a_run_is_written_with_its_manifest_and_again(spark, tmp_path):
    want = {f"s{i % 3}/page {i}.txt": f"é {i}\n" * i for i in range(20)}
    rows = spark.createDataFrame(list(want.items()), "name string, content string").repartition(5)
    for _ in range(2):  # repeated, the same files
        path = artefacts.write_run(rows, str(tmp_path), "one")
        found = files_under(path)
        listed = [json.loads(line) for name, data in found.items() if name.startswith("_manifest/part") for line in data.decode().splitlines()]
        assert {n: d.decode() for n, d in found.items() if not n.startswith("_")} == want
        assert {m["name"]: (m["bytes"], m["sha256"]) for m in listed} == {n: (len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for n, t in want.items()}
        assert json.loads(found["_manifest/run.json"]) == {"run": "one", "files": 20, "bytes": sum(len(t.encode()) for t in want.values())}
    assert os.listdir(tmp_path) == ["one"]
    fewer = artefacts.write_run(rows.filter("name like 's1/%'"), str(tmp_path), "one")
    assert {n.split("/")[0] for n in files_under(fewer)} == {"s1", "_manifest"}
    assert set(files_under(artefacts.write_run(rows.limit(0), str(tmp_path), "none"))) == {"_manifest/run.json"}


def test_a_failed_task_leaves_no_file_and_the_earlier_run(spark, tmp_path):
    artefacts.write_run(spark.createDataFrame([("a", "old")], "name string, content string"), str(tmp_path), "r")

    @udf("string")
    def failing(name):
        if name == "n7":
            raise RuntimeError("broken row")
        return name

    rows = spark.range(10).repartition(3).select(F.concat(F.lit("n"), "id").alias("name")).withColumn("content", failing("name"))
    with pytest.raises(Exception, match="broken row"):
        rows.write.format("artefacts").option("run", "r").mode("append").save(str(tmp_path))
    assert os.listdir(tmp_path) == ["r"] and files_under(tmp_path / "r")["a"] == b"old"


@pytest.mark.parametrize("names", [["../a"], ["/a"], ["a/../b"], [None], ["a", "a"], [""], ["a//b"], ["_manifest/x"], ["a/.hidden"]])
def test_names_that_are_refused(spark, tmp_path, names):
    with pytest.raises(ValueError, match="no name of a file"):
        artefacts.write_run(spark.createDataFrame([(n, "x") for n in names], "name string, content string"), str(tmp_path), "r")
    assert not os.listdir(tmp_path)


def test_lines_have_their_files_order(spark, tmp_path):
    want = []
    for i in range(7):
        path = tmp_path / f"d{i % 3}" / f"x{i}" / "predictions.jsonl"
        path.parent.mkdir(parents=True)
        lines = [f"{i} {j}" if j % 4 else " " for j in range(i * 3000)]
        path.write_text("\r\n".join(lines))
        want += [(str(path), j, line) for j, line in enumerate(lines) if line.strip()]
    (tmp_path / "other.jsonl").write_text("no")
    (tmp_path / "_old").mkdir()
    (tmp_path / "_old" / "predictions.jsonl").write_text("hidden")
    for most in (1 << 10, 1 << 30):
        lines = artefacts.read_lines(spark, str(tmp_path), "predictions.jsonl", most)
        assert [tuple(r) for r in lines.orderBy("path", "row").collect()] == sorted(want)
    assert lines.rdd.getNumPartitions() == 1
    assert artefacts.read_lines(spark, str(tmp_path / "absent")).count() == 0


def test_broken_lines_are_rows_and_absent_fields_have_defaults(spark, tmp_path):
    (tmp_path / "split.jsonl").write_text('{"sample_id": "a", "tasks": ["t"]}\n{"sample_id": \n\n[1]\n{"sample_id": "b", "more": 1}\n')
    lines = artefacts.read_lines(spark, str(tmp_path))
    rows = artefacts.parsed_lines(lines, "sample_id string, tasks array<string>, n int", {"tasks": F.array().cast("array<string>"), "n": 3}).orderBy("row").collect()
    assert [(r.row, r.sample_id, r.tasks, r.n) for r in rows] == [(0, "a", ["t"], 3), (1, None, None, None), (3, None, None, None), (4, "b", [], 3)]
    assert [r.broken for r in rows] == [None, '{"sample_id": ', "[1]", None]


def test_mentions_equal_contains(spark):
    ids = ["s1", "s11", "1/s", "é", "", None, "none", "s1", "pages", "age"]
    texts = [f"root/s{i}/pages/é{i % 5}.png" for i in range(120)] + ["", None, "s1", "s1s1"]
    want = {(i, t) for i in ids if i for t in texts if t and i in t}
    frame = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    for most in (2, 100):
        got = mentions.mentions(frame(ids, "id"), frame(texts, "text"), most)
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
        rows = [tuple(r) for r in got.collect()]
        assert set(rows) == want and len(rows) == len(want)
    assert mentions.mentions(frame([], "id"), frame(texts, "text")).count() == mentions.mentions(frame(ids, "id"), frame([], "text")).count() == 0


def test_predictions_of_samples(spark):
    rows = [("f", 0, ["a/s1.png", "a/s1_2.png"]), ("f", 1, ["s2"]), ("g", 0, []), ("g", 1, None)]
    got = mentions.predictions_of_samples(spark.createDataFrame([("s1",), ("s",)], "sample_id string"), spark.createDataFrame(rows, "path string, row long, input_images array<string>"))
    assert sorted((r.sample_id, r.path, r.row) for r in got.collect()) == [("s", "f", 0), ("s", "f", 1), ("s1", "f", 0)]


def paths(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "path string")


def test_listings_of_samples_views_and_truth(spark, tmp_path):
    listed = paths(spark, "07/b/page_001_view_classification.json", "07/a/page_001_view_classification.json", "07/a-copy/page_001_view_classification.json", "07/c/other.json")
    ids = lambda *a, **k: [r.sample_id for r in files.sample_ids(listed, r"^page_001_view_classification\.json$", *a, **k).collect()]
    assert ids() == ["a", "a-copy", "b"] and ids(copies=False) == ["a", "b"]
    crops = paths(spark, "06/a/view_2/x.png", "06/a/view_2/y.png", "06/a/view_10/x.png", "06/a/other/x.png", "06/a-copy/view_1/x", "06/a-Copy/view_1/x", "06/testView2CAD/view_1/x")
    assert [tuple(r) for r in files.segmentation_views(crops).collect()] == [("a", "view_10"), ("a", "view_2"), ("a-Copy", "view_1")]
    assert len(files.segmentation_views(crops, copies=True).collect()) == 4
    steps = paths(spark, "r/A.STEP", "r/A.stp", "r/a.step", "r/B.Stp", "r/C.pdf")
    assert {tuple(r) for r in files.step_truth(steps).collect()} == {("A", "r/A.STEP"), ("a", "r/a.step"), ("B", "r/B.Stp")}
    for name in ("b.pdf", "A.pdf", "c.PDF"):
        (tmp_path / name).write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in files.pdfs(spark, str(tmp_path)).collect()] == ["A.pdf", "b.pdf"]
    images = spark.createDataFrame([("a", "c2.png", False), ("a", "page.png", True), ("a", "c1.png", False), ("b", "c.png", False)], "sample_id string, path string, is_page boolean")
    assert {r.sample_id: r.images for r in files.generation_images(images).collect()} == {"a": ["page.png", "c1.png", "c2.png"], "b": ["c.png"]}


def test_crops_cut_elsewhere(spark):
    said = {"imagePath": "x.png", "group_min_x": 10.5, "group_min_y": "11.5", "imageWidth": 30, "imageHeight": 20, "group_id": 4, "shapes": [{"label": "b"}, {}, {"label": "a"}, {"label": "b"}]}
    docs = spark.createDataFrame([("s/cut-json/v1.json", json.dumps(said)), ("s/cut-json/v2.json", "{}"), ("s/cut-json/v3.json", "no")], "path string, text string")
    rows = {r.view_id: r for r in files.external_crops(docs).collect()}
    one = rows["v1"]
    assert (one.bbox, one.image_path, one.image_size, one.group_id, one.num_shapes) == ([10, 12, 40, 32], "s/cut-img/x.png", [30, 20], "4", 4)
    assert [tuple(x) for x in one.labels] == [("a", 1), ("b", 2), ("unknown", 1)]
    assert rows["v2"].bbox == rows["v3"].bbox == [0, 0, 0, 0] and rows["v2"].image_path == "s/cut-img/v2.png" and rows["v3"].labels == []


def test_split_and_predictions(spark, tmp_path):
    (tmp_path / "small.jsonl").write_text('{"sample_id": "a", "tasks": ["t"], "ground_truth": {"t": {"k": 1}}}\n\n{"tasks": []}\nbroken\n{"sample_id": "b"}\n')
    rows = files.split_cases(spark, str(tmp_path), "small.jsonl").orderBy("row").collect()
    assert [(r.row, r.sample_id, r.tasks, r.input_images, r.truth, r.broken) for r in rows] == [
        (0, "a", ["t"], [], {"t": '{"k":1}'}, None), (2, None, [], [], {}, "no sample_id"), (3, None, None, None, None, "broken"), (4, "b", [], [], {}, None),
    ]
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "predictions.jsonl").write_text('{"task": "t", "prediction": {"a": [1]}, "latency_sec": 2}\n')
    (row,) = files.prediction_records(spark, str(tmp_path)).select("task", "input_images", "latency_sec", F.to_json("prediction").alias("p")).collect()
    assert tuple(row) == ("t", [], 2.0, '{"a":[1]}')


def test_files_of_documents_pages_and_runs(spark):
    docs = spark.createDataFrame([("a/r.json", '{"k":"é","l":[1,null]}')], "output_path string, document string")
    assert sinks.json_files(docs).first().content == '{\n  "k": "é",\n  "l": [\n    1,\n    null\n  ]\n}\n'
    pages = spark.createDataFrame([("s", 2, b"c", None)], "sample_id string, page int, clean binary, mask binary")
    assert [tuple(r) for r in sinks.page_files(pages).collect()] == [("04.CleanPNG/s/page_002_clean.png", b"c")]
    runs = spark.createDataFrame([("s", "p", None), ("t", "q", "r")], "sample_id string, prompt string, raw string")
    assert {tuple(r) for r in sinks.run_texts(runs).collect()} == {("s/prompt.md", "p"), ("t/prompt.md", "q"), ("t/raw_response.txt", "r")}


def test_small_files_are_spread_and_read_together(tmp_path):
    for i in range(3000):
        (tmp_path / f"f{i:04d}.jsonl").write_text(f'{{"a": {i}}}\n')
    reader = artefacts.LineReader(f"file://{tmp_path}", "*.jsonl", 64 << 20)
    parts = reader.partitions()
    assert [len(p.paths) for p in parts] == [1024, 1024, 952]
    batches = [list(reader.read(p)) for p in parts]
    assert [len(b) for b in batches] == [1, 1, 1]
    assert [r["text"] for b in batches for r in b[0].to_pylist()] == [f'{{"a": {i}}}' for i in range(3000)]


def test_what_makes_a_runs_files_runs_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def made(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    files_ = spark.range(7).selectExpr("concat('d/', id, '.txt') AS name", "'x' AS content").mapInArrow(made, "name string, content string")
    artefacts.write_run(files_, f"file://{tmp_path}", "r")
    assert seen.value == 7


def test_what_makes_predictions_runs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def made(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([("p", 0, ["x/s1/a", "s12"]), ("p", 1, ["none"]), ("q", 0, None)], "path string, row long, input_images array<string>")
    given = rows.mapInArrow(made, rows.schema)
    found = mentions.predictions_of_samples(spark.createDataFrame([("s1",), ("s12",)], "sample_id string"), given)
    assert sorted((r.sample_id, r.path, r.row) for r in found.collect()) == [("s1", "p", 0), ("s12", "p", 0)]
    assert seen.value == 3


def test_files_are_listed_and_dealt_out_by_tasks(spark, tmp_path):
    """Level by level, as a walk finds them; no plan holds their paths."""
    want = {}
    for i in range(300):
        folder = tmp_path / f"d{i % 2}" / f"x{i % 150}" if i % 3 else tmp_path / f"x{i}" / ".hidden" / "y" if i % 2 else tmp_path
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i}.jsonl").write_text(f"{i}\n" * (i % 5))
        if ".hidden" not in folder.parts:
            want[str(folder / f"{i}.jsonl")] = len(f"{i}\n" * (i % 5))
    (tmp_path / "_x").mkdir()
    (tmp_path / "_x" / "a.jsonl").write_text("hidden")
    (tmp_path / "d0" / "other.txt").write_text("no")
    assert {r.path: r["size"] for r in artefacts.listed(spark, str(tmp_path), "*.jsonl").collect()} == want
    lines = artefacts.read_lines(spark, f"file://{tmp_path}", most_bytes=1 << 14)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "BatchScan" not in plan
    assert {r.path: r.n * (len(r.path.split("/")[-1].split(".")[0]) + 1) for r in lines.groupBy("path").agg(F.count("row").alias("n")).collect()} == {p: n for p, n in want.items() if n}
