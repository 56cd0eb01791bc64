"""Batch stages that go on where they stopped, and sizes of pages."""

import json
import os

import pytest
from pyspark.sql import functions as F

from draftlake.operators import detections, record, views
from draftlake.plans import batch, stage

KEYS = ["sample_id", "page"]
LAYOUT = "sample_id string, page int, ord int, region_type string, x1 int, y1 int, x2 int, y2 int"


def inputs(spark, *rows):
    """sample_id, page, text and size of documents."""
    given = spark.createDataFrame(list(rows), "sample_id string, page int, text string, size long")
    return given.withColumns({"path": F.concat("sample_id", F.lit(".json")), "time": F.lit(0).cast("timestamp")})


def page(*views_):
    return json.dumps({"image_size": {"width": 100, "height": 100}, "views": list(views_)})


GOOD, LOW = {"view_id": "a", "bbox": [10, 20, 60, 80], "score": 0.9}, {"view_id": "b", "bbox": ["1.5", 2.5, "x", 4], "score": 0.9}


def work(spark):
    nothing = spark.createDataFrame([], LAYOUT)
    return lambda todo: detections.filter_documents(record.read(todo), nothing)


def told(result):
    return {r.sample_id: (r.status, r.error, dict(r.counts)) for r in result.status.collect()}


def test_a_second_run_does_what_has_changed(spark, tmp_path):
    first = [("a", 1, page(GOOD, LOW, 7), 1), ("b", 1, "{", 1), ("c", 1, page(), 1), (None, 1, "[]", 1), ("d", None, page(GOOD), 1)]
    run = lambda rows, name, **options: batch.run_stage(inputs(spark, *rows), work(spark), str(tmp_path), KEYS, name, **options)
    one = run(first, "1")
    assert told(one) == {
        "a": ("done", None, {"accepted": 1, "rejected": 1}), "b": ("failed", "Invalid JSON in b.json: Expecting property name enclosed in double quotes", {}), "c": ("done", None, {}),
        None: ("failed", "document is not an object", {}), "d": ("done", None, {"accepted": 1}),
    }
    assert {(r.view_id, r.kind, r.reject_reason) for r in one.result.filter("sample_id = 'a'").collect()} == {("a", "accepted", None), ("b", "rejected", "invalid_bbox")}
    assert stage.counts(one.status).first().asDict() == {"total": 5, "done": 3, "failed": 2}
    two = run([("a", 1, page(GOOD), 2), *first[1:]], "2")
    assert set(told(two)) == {"a", "b", None} and told(two)["a"] == ("done", None, {"accepted": 1})
    third = run([("a", 1, page(GOOD), 2), first[2], first[4]], "3")
    assert told(third) == {}
    now = batch.results(spark, str(tmp_path), KEYS).collect()
    assert sorted((r.sample_id, r.view_id) for r in now) == [("a", "a"), ("d", "a")]
    assert {r.sample_id: r.status for r in batch.latest(spark, str(tmp_path), KEYS).collect()} == {"a": "done", "b": "failed", "c": "done", None: "failed", "d": "done"}


def test_a_run_that_died_is_done_again(spark, tmp_path, monkeypatch):
    rows = [("a", 1, page(GOOD), 1)]

    def dies(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(batch, "_counted", dies)
        with pytest.raises(RuntimeError, match="lost"):
            batch.run_stage(inputs(spark, *rows), work(spark), str(tmp_path), KEYS, "1")
    assert batch.latest(spark, str(tmp_path), KEYS) is None and batch.results(spark, str(tmp_path), KEYS) is None
    assert told(batch.run_stage(inputs(spark, *rows), work(spark), str(tmp_path), KEYS, "1")) == {"a": ("done", None, {"accepted": 1})}
    assert batch.results(spark, str(tmp_path), KEYS).count() == 1


def test_stopping_at_the_first_error(spark, tmp_path):
    with pytest.raises(Exception, match="document is not an object"):
        batch.run_stage(inputs(spark, ("a", 1, "3", 1)), work(spark), str(tmp_path), KEYS, "1", fail_fast=True)
    assert batch.latest(spark, str(tmp_path), KEYS) is None


def test_fingerprints_of_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "page_001_views.json").write_text("{}")
    os.utime(tmp_path / "s" / "page_001_views.json", (100, 100))
    (row,) = batch.fingerprints(spark, str(tmp_path)).collect()
    assert row.path.endswith("s/page_001_views.json") and row.size == 2 and row.time.timestamp() == 100


@pytest.mark.parametrize(("size", "want"), [({"width": 9, "height": 8}, (9, 8)), ({"width": "9", "height": 8.9}, (9, 8)), ({"width": 0, "height": 8}, (70, 90)), ([5, 0], (5, 0)), ([5], (70, 90)), (None, (70, 90)), ("x", (70, 90))])
def test_page_size_chain(spark, size, want):
    found = spark.createDataFrame([("s", 1, 0, 70, 20), ("s", 1, 1, 30, 90), ("s", 2, 0, 500, 500)], "sample_id string, page int, ord int, x2 int, y2 int")
    doc = spark.createDataFrame([("s", 1, json.dumps({"image_size": size}))], "sample_id string, page int, text string").withColumn("doc", F.try_parse_json("text"))
    got = {(r.page, r.ord): (r.page_width, r.page_height) for r in views.with_page_size(found, doc).collect()}
    assert got == {(1, 0): want, (1, 1): want, (2, 0): (500, 500)}


def python_steps(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_the_filter_reads_documents_once(spark):
    """Each reading of a document is one Python step over all texts."""
    todo = inputs(spark, ("a", 1, page(GOOD), 1))
    assert python_steps(work(spark)(todo)) == 1
