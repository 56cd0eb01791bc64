"""Files of a run as a Spark data source: one named file a row out, one line a row in.

Writing (``format("artefacts")``; columns name and content): tasks put their files in a hidden folder of the job. When all tasks
have ended, the driver renames it to the run's folder, with one renaming; when one fails for good, it's removed. A task that's
tried again writes the same names again, each by way of a renaming, so nobody ever sees a part of a file, and a run that is
repeated replaces its folder. Beside the files lies ``_manifest``: a JSON line for each file (name, bytes, sha256), a part for
each task, and ``run.json`` with the totals. Only totals of tasks pass the driver.

Reading (``read_lines``; columns path, row, text): tasks list the folders, a level of them at a time, and write what they find; the driver sees counts and the
total of sizes only. Files are dealt to tasks, up to ``bytes`` each, small files counted as a thousandth of it; a file's lines are streamed and numbered from 0,
blank ones counted but left out. ``format("artefact_lines")`` reads the same, lazily, but plans its partitions on the driver: for runs of few files.

Stores are those that pyarrow's file systems reach under the given path; renaming a folder must be one operation there, as it is
on HDFS and mounted disks. Cases: null names or contents, names that leave the run's folder, and names that occur twice are errors before
anything is written; an empty table gives a run without files; empty files have no lines.
"""

from __future__ import annotations

import contextlib
import fnmatch
import hashlib
import io
import json
import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.raster import held, shared_folder

MANIFEST, LINES = "_manifest", pa.schema([("path", pa.string()), ("row", pa.int64()), ("text", pa.string())])
BYTES_OF_PARTITION, LINES_OF_BATCH, ABORTS = 64 << 20, 8192, 3
#: Opening a file counts as at least this part of a partition's bytes, so that many small files are spread over tasks.
OPENED = 1024
#: Folders that a task lists at least.
FOLDERS = 64


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class RunWriter(DataSourceArrowWriter):
    def __init__(self, root: str, run: str) -> None:
        self.root, self.run, self.job = root, run, uuid.uuid4().hex
        store, root = self._store()
        store.create_dir(self._pending(root))  # by nobody else: tasks that outlive an abort find it gone

    def _store(self) -> tuple[fs.FileSystem, str]:
        store, root = fs.FileSystem.from_uri(self.root)
        return store, root.rstrip("/")

    def _pending(self, root: str) -> str:
        return f"{root}/.{self.run}-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = self._store()
        pending, task, made, known = self._pending(root), TaskContext.get(), [], set()

        def put(name: str, content: bytes) -> None:
            beside = f"{pending}/.attempt-{task.taskAttemptId()}"
            with store.open_output_stream(beside) as out:
                out.write(content)
            folder = posixpath.dirname(f"{pending}/{name}")
            if folder not in known:
                store.create_dir(folder)
                known.add(folder)
            store.move(beside, f"{pending}/{name}")

        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content = content.encode() if isinstance(content, str) else content
                put(name, content)
                made.append({"name": name, "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()})
        if made:
            put(f"{MANIFEST}/part-{task.partitionId():05d}.jsonl", "".join(json.dumps(m) + "\n" for m in made).encode())
        return Written(len(made), sum(m["bytes"] for m in made))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        pending, target, old = self._pending(root), f"{root}/{self.run}", f"{root}/.{self.run}-old-{self.job}"
        store.create_dir(f"{pending}/{MANIFEST}")
        done = [m for m in messages if m is not None]
        with store.open_output_stream(f"{pending}/{MANIFEST}/run.json") as out:
            out.write(json.dumps({"run": self.run, "files": sum(m.files for m in done), "bytes": sum(m.size for m in done)}).encode())
        there = store.get_file_info(target).type != fs.FileType.NotFound
        if there:
            store.move(target, old)
        store.move(pending, target)
        if there:
            store.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        for _ in range(ABORTS):
            if store.get_file_info(self._pending(root)).type != fs.FileType.NotFound:
                with contextlib.suppress(OSError):  # a task that's being stopped has just made a file
                    store.delete_dir(self._pending(root))
            time.sleep(0.3)


class Artefacts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artefacts"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> RunWriter:
        return RunWriter(self.options["path"], self.options["run"])


@dataclass
class Files(InputPartition):
    paths: list[str]


class LineReader(DataSourceReader):
    def __init__(self, root: str, pattern: str, most: int) -> None:
        self.root, self.pattern, self.most = root, pattern, most

    def partitions(self) -> list[Files]:
        store, root = fs.FileSystem.from_uri(self.root)
        listed = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        hidden = lambda path: any(part.startswith((".", "_")) for part in path.removeprefix(root).split("/"))
        found = sorted((f.path, f.size or 0) for f in listed if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, self.pattern) and not hidden(f.path))
        parts, size, least = [], 0, self.most // OPENED
        for path, of in ((path, max(of, least)) for path, of in found):  # folders lie together in this order
            if not parts or size + of > self.most:
                parts.append(Files([]))
                size = 0
            parts[-1].paths.append(path)
            size += of
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.root)
        paths, rows, texts = [], [], []  # of many small files together
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(rows, pa.int64()), pa.array(texts, pa.string())], schema=LINES)
        for path in partition.paths:
            with io.BufferedReader(store.open_input_file(path), 1 << 20) as raw:
                for row, line in enumerate(raw):
                    text = line.decode("utf-8", "replace").rstrip("\r\n")
                    if text.strip():
                        paths.append(path)
                        rows.append(row)
                        texts.append(text)
                    if len(rows) == LINES_OF_BATCH:
                        yield batch()
                        paths, rows, texts = [], [], []
        if rows:
            yield batch()


class ArtefactLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artefact_lines"

    def schema(self) -> str:
        return "path string, row long, text string"

    def reader(self, schema) -> LineReader:
        return LineReader(self.options["path"], self.options.get("pattern", "*.jsonl"), int(self.options.get("bytes", BYTES_OF_PARTITION)))


def write_run(files: DataFrame, root: str, run: str) -> str:
    """Write files (name, content: text or binary) as run's folder under root; its path."""
    spark = files.sparkSession
    name = F.col("name")
    if not run or run.startswith((".", "_")) or "/" in run:
        raise ValueError(f"no name of a file of its own: {run}")
    # what makes the files runs once: they're checked and written from this
    held = shared_folder(spark, "files")
    files.select("name", F.col("content").cast("binary").alias("content")).write.parquet(held)
    files = spark.read.schema("name string, content binary").parquet(held)
    leaves = name.isNull() | F.col("content").isNull() | F.startswith(name, F.lit("/")) | name.rlike(r"(^|/)(\.\.?|)(/|$)|(^|/)[._]")
    names = files.groupBy("name").agg((F.bool_or(leaves) | (F.count(F.lit(1)) > 1)).alias("bad")).filter("bad")
    bad = names.agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name")).first()
    if bad["n"]:
        raise ValueError(f"no name of a file of its own: {bad['name']}")
    spark.dataSource.register(Artefacts)
    files.write.format("artefacts").option("run", run).mode("append").save(root)
    return f"{root.rstrip('/')}/{run}"


def listed(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path and size of the files under root whose names match, hidden ones and folders left out. Each round's folders are listed by tasks and
    what they hold is written, so that neither files nor folders are gathered anywhere; there are as many rounds as levels."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        for folder in (f for batch in batches for f in batch.column(0).to_pylist()):
            found = [f for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if not f.base_name.startswith((".", "_"))]
            found = [f for f in found if f.type == fs.FileType.Directory or f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern)]
            for low in range(0, len(found), LINES_OF_BATCH):
                part = found[low : low + LINES_OF_BATCH]
                sizes = [(f.size or 0) if f.type == fs.FileType.File else None for f in part]
                yield pa.RecordBatch.from_arrays([pa.array([f.path for f in part], pa.string()), pa.array(sizes, pa.int64())], ["path", "size"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, n, levels = spark.createDataFrame([(fs.FileSystem.from_uri(root)[1],)], "path string"), 1, []
    while n:
        dealt = folders.repartition(max(1, min(tasks, n // FOLDERS)), "path")
        found = held(dealt.mapInArrow(entries, "path string, size long"), "listed")
        levels.append(found.filter("size IS NOT NULL"))
        folders = found.filter("size IS NULL").select("path")
        n = folders.count()
    return reduce(DataFrame.unionByName, levels)


def read_lines(spark: SparkSession, root: str, pattern: str = "*.jsonl", most_bytes: int = BYTES_OF_PARTITION) -> DataFrame:
    """path, row and text of the lines, not blank, of files under root whose names match. The files are listed when this is called."""
    found, reader = listed(spark, root, pattern), LineReader(root, pattern, most_bytes)
    total = found.agg(F.sum(F.greatest("size", F.lit(most_bytes // OPENED)))).first()[0] or 0

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from reader.read(Files(batch.column(0).to_pylist()))

    return found.select("path").repartition(max(1, -(-total // most_bytes)), "path").mapInArrow(lines, "path string, row long, text string")


def parsed_lines(lines: DataFrame, schema: str, defaults: dict | None = None) -> DataFrame:
    """path, row, the fields of each line's JSON object (defaults where absent; null else) and broken: the line, if it's none."""
    object_ = F.from_json("text", f"{schema}, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    rows = lines.select("path", "row", F.col("text"), object_.alias("o")).select("path", "row", "o.*", F.when(F.col("o").isNull(), F.col("text")).alias("_t"))
    rows = rows.withColumn("broken", F.coalesce("broken", "_t")).drop("_t")
    return rows.withColumns({k: F.when(F.col("broken").isNull(), F.coalesce(k, v if not isinstance(v, (str, int, float)) else F.lit(v))) for k, v in (defaults or {}).items()})
