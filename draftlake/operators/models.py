"""Models as stages: which task asks what, and any callable over (prompt, images) run in batches bounded in bytes.

A model is loaded once in each worker and called with a list of requests; it returns one text for each, or an exception in a text's
place. A call that fails is made again request by request, so that one bad request leaves a row with its error and takes no other along.

Cases: null prompts and null images are given as they are; a null answer is an error, an empty one is an answer; a
request larger than a batch is a batch of its own; repeated requests are asked each; no requests, no rows. What isn't a key isn't carried: join the answers by
the keys. A loader that fails stops the stage, as no request could be answered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Each task's name, the pictures that it looks at, its measure.
TASKS = (
    ("view_count", "page_png", "exact_match"),
    ("view_classification", "page_png", "accuracy"),
    ("dimension_ocr", "annotated_view_png", "text_f1"),
    ("feature_count", "clean_view_png", "count_accuracy"),
    ("json_stability", "any_image", "parse_rate"),
)
BATCH_BYTES = 32 << 20
ANSWER = ("answer", "error")


class Request(NamedTuple):
    prompt: str | None
    images: list[Any]


Model = Callable[[Sequence[Request]], Sequence[Any]]
Loader = Callable[[], Model]
_loaded: dict[str, Model] = {}


def tasks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TASKS, "task string, image_level string, metric string")


def requests(cases: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """cases(task, ...) with image_level and metric of their task (known: task, image_level, metric; TASKS, if it isn't given), and error
    for a task that isn't known; a null task is none that is known."""
    known = tasks(cases.sparkSession) if known is None else known
    free = "_" * (1 + max(map(len, cases.columns)))  # a prefix that no column of cases has
    there = known.select(F.col("task").alias(f"{free}task"), F.struct("image_level", "metric").alias(f"{free}of"))
    joined = cases.join(there, F.col("task") == F.col(f"{free}task"), "left")  # Spark broadcasts it where its size allows
    unknown = F.when(F.col(f"{free}of").isNull(), F.concat(F.lit("Unknown task: "), F.coalesce("task", F.lit("null"))))
    return joined.select(*[cases[c] for c in cases.columns], f"{free}of.image_level", f"{free}of.metric", unknown.alias("error"))


def task_lists(cases: DataFrame, *by: str) -> DataFrame:
    """The distinct tasks of each group, in order."""
    return cases.groupBy(*by).agg(F.array_sort(F.collect_set("task")).alias("tasks"))


def chosen(loaders: Mapping[str, Loader], names: Iterable[str]) -> dict[str, Loader]:
    """The loaders of these names; KeyError that says which are known."""
    found = {}
    for name in names:
        if name not in loaders:
            raise KeyError(f"Unknown model: {name}. Known models: {', '.join(sorted(loaders))}")
        found[name] = loaders[name]
    return found


def _model(name: str, load: Loader) -> Model:
    """The worker's own model. (A function of the module, as what is sent with a task has its own copy of the module's variables.)"""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def _bytes(request: Request) -> int:
    sizes = [len(v) for image in request.images for v in (image.values() if isinstance(image, dict) else [image]) if isinstance(v, (str, bytes))]
    return len(request.prompt or "") + sum(sizes)


def _batches(asked: Iterable[Request], limit: int) -> Iterator[list[Request]]:
    held, size = [], 0
    for request in asked:
        own = _bytes(request)
        if held and size + own > limit:
            yield held
            held, size = [], 0
        held.append(request)
        size += own
    if held:
        yield held


def _said(problem: Exception) -> tuple[None, str]:
    return None, f"{type(problem).__name__}: {problem}"


def _ask(model: Model, asked: list[Request]) -> list[tuple[str | None, str | None]]:
    """(answer, error) of each request."""
    try:
        given = list(model(asked))
        if len(given) != len(asked):
            raise ValueError(f"{len(given)} answers to {len(asked)} requests")
    except Exception as problem:  # noqa: BLE001 - any failure of a model is an error row
        return [_said(problem)] if len(asked) == 1 else [answer for one in asked for answer in _ask(model, [one])]
    return [_said(g) if isinstance(g, Exception) else (None, "no answer") if g is None else (str(g), None) for g in given]


def answers(wanted: DataFrame, name: str, load: Loader, keys: Sequence[str], batch_bytes: int = BATCH_BYTES, profile: ResourceProfile | None = None) -> DataFrame:
    """The keys, answer and error of each row of wanted (keys, prompt, images array). name: what the worker keeps the loaded model under.
    profile: resources of this stage's tasks, where they aren't the session's."""
    if clash := set(keys) & set(ANSWER):
        raise ValueError(f"keys can't be named {', '.join(sorted(clash))}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, low = batch.select(list(range(len(keys)))), 0
            asked = (Request(p.as_py(), i.as_py() or []) for p, i in zip(batch.column(len(keys)), batch.column(len(keys) + 1), strict=True))
            for part in _batches(asked, batch_bytes):
                given, problems = zip(*_ask(_model(name, load), part), strict=True)
                found = [*own.slice(low, len(part)).columns, pa.array(given, pa.string()), pa.array(problems, pa.string())]
                yield pa.RecordBatch.from_arrays(found, names=[*keys, *ANSWER])
                low += len(part)

    kinds = dict(wanted.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "answer string", "error string"])
    return wanted.select(*keys, "prompt", "images").mapInArrow(run, schema, profile=profile)


def screen(wanted: DataFrame, loaders: Mapping[str, Loader], names: Sequence[str], keys: Sequence[str], batch_bytes: int = BATCH_BYTES, profile: ResourceProfile | None = None) -> DataFrame:
    """The answers of several models to the same requests: model, keys, answer, error."""
    own = [answers(wanted, name, load, keys, batch_bytes, profile).select(F.lit(name).alias("model"), *keys, *ANSWER) for name, load in chosen(loaders, names).items()]
    return reduce(DataFrame.unionByName, own)
