"""Models as stages, with plain functions for models."""

import os

import pytest

from draftlake.operators import models


def _echo():
    def model(asked):
        if any(r.prompt == "bad" for r in asked):
            raise RuntimeError("can't read it")
        return [None if r.prompt is None else f"{r.prompt}:{len(r.images)}:{len(asked)}" for r in asked]

    return model


def _short():
    return lambda asked: ["only one"] if len(asked) > 1 else [ValueError("refused") if asked[0].prompt == "no" else asked[0].prompt]


def _wanted(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, ord long, prompt string, images array<binary>").coalesce(1)


def test_failures_are_rows_and_take_no_other_along(spark):
    rows = [("s", 2**60 + 1, "a", [b"1", b"2"]), ("s", 2, "bad", []), (None, None, None, None), ("s", 4, "", [None]), ("s", 2, "bad", [])]
    found = models.answers(_wanted(spark, rows), "echo", _echo, ["sample_id", "ord"]).collect()
    bad = ("s", 2, None, "RuntimeError: can't read it")
    assert sorted(str(tuple(r)) for r in found) == sorted(map(str, [("s", 2**60 + 1, "a:2:1", None), bad, (None, None, None, "no answer"), ("s", 4, ":1:1", None), bad]))


def test_batches_are_bounded_in_bytes(spark):
    rows = [("s", i, "p", [b"x" * 9]) for i in range(6)] + [("s", 6, "p", [b"x" * 500])]
    found = models.answers(_wanted(spark, rows), "echo", _echo, ["ord"], batch_bytes=20).collect()
    assert {r.ord: r.answer for r in found} == {**{i: "p:1:2" for i in range(6)}, 6: "p:1:1"}


def test_wrong_number_of_answers_and_refusals(spark):
    found = models.answers(_wanted(spark, [("s", 1, "yes", []), ("s", 2, "no", [])]), "short", _short, ["ord"]).collect()
    assert {tuple(r) for r in found} == {(1, "yes", None), (2, None, "ValueError: refused")}


def test_a_model_is_loaded_once_in_a_worker(spark, tmp_path):
    def load():
        (tmp_path / f"{os.getpid()}-{os.urandom(4).hex()}").touch()
        return lambda asked: [r.prompt for r in asked]

    wanted = _wanted(spark, [("s", i, "p", [b"x"]) for i in range(50)]).repartition(8)
    assert models.answers(wanted, f"once {tmp_path}", load, ["ord"], batch_bytes=1).count() == 50
    workers = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert workers and len(workers) == len(set(workers))


def test_names(spark):
    wanted = _wanted(spark, [("s", 1, "p", [])])
    found = models.screen(wanted, {"b": _short, "a": _echo}, ["a", "b"], ["ord"]).collect()
    assert {tuple(r) for r in found} == {("a", 1, "p:0:1", None), ("b", 1, "p", None)}
    with pytest.raises(KeyError, match="Unknown model: c. Known models: a, b"):
        models.chosen({"b": _short, "a": _echo}, ["a", "c"])
    with pytest.raises(ValueError, match="error"):
        models.answers(wanted.withColumn("error", wanted.ord), "echo", _echo, ["error"])
    assert models.answers(wanted.limit(0), "echo", _echo, ["ord"]).count() == 0


def test_tasks(spark):
    cases = spark.createDataFrame([(1, "view_count", "kept"), (1, "nothing", None), (2, None, ""), (1, "view_count", "kept")], "c int, task string, _task string")
    found = {tuple(r) for r in models.requests(cases).collect()}
    assert found == {(1, "view_count", "kept", "page_png", "exact_match", None), (1, "nothing", None, None, None, "Unknown task: nothing"), (2, None, "", None, None, "Unknown task: null")}
    assert models.requests(cases).count() == 4
    assert {r.c: r.tasks for r in models.task_lists(cases, "c").collect()} == {1: ["nothing", "view_count"], 2: []}
