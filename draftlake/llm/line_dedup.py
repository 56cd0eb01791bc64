"""Line deduplication over levelled sorted runs of line hashes. DataFrame functions only.

A run holds (key hash, number of documents), sorted by hash. A batch of documents counts its own keys and goes through the
runs one by one, the highest level first, with a merge-anti-join against the keys that the run holds as settled (found in
enough documents: nothing is to be learned of them any more); what is left is a run of level 0. When a level has ``fanout`` runs, they're
merged into one run of the next level, which settles the keys that only together are frequent. Runs are summed once, at the end; the keys
then settled lose all their lines in every document.

Cases: a null or empty text is one empty line, which is never dropped (keys need at least one code point);
rows that share a doc_id count as one document, and each keeps its own text's lines; documents with null
ids are told apart by their text; an empty table gives an empty result; extra columns are carried along, but for those
that the result has itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACES, ascii_lower, carried, materialise

MIN_DOCUMENTS, BATCHES, FANOUT = 10, 4, 3


def line_key(line: Column) -> Column:
    """128-bit hash of the stripped, lower-cased line; null for a line with nothing left."""
    key = ascii_lower(F.btrim(line, F.lit(SPACES)))
    return F.when(key != "", F.md5(key))


class LineRuns:
    """The levels of runs, as tables in the shared folder. add() takes one batch of (key, docs)."""

    def __init__(self, min_documents: int = MIN_DOCUMENTS, fanout: int = FANOUT) -> None:
        self.min_documents, self.fanout, self.levels = min_documents, fanout, []

    def _write(self, counts: DataFrame, level: int) -> None:
        run = materialise(counts.select("key", "docs").sortWithinPartitions("key"), f"line-run-l{level}")
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def runs(self) -> list[DataFrame]:
        """All runs, the highest level first."""
        return [run for level in reversed(self.levels) for run in level]

    def settled(self) -> DataFrame:
        """The keys found in enough documents, with their numbers."""
        return self._enough(_sum(self.runs()))

    def _enough(self, run: DataFrame) -> DataFrame:
        return run.filter(F.col("docs") >= self.min_documents)

    def add(self, counts: DataFrame) -> None:
        """One batch: without the keys that a run has settled, as a run of its own."""
        for run in self.runs():
            counts = counts.hint("merge").join(self._enough(run).select("key").hint("merge"), "key", "left_anti")
        self._write(counts, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._write(_sum(runs), level + 1)
            level += 1


def _sum(runs: list[DataFrame]) -> DataFrame:
    union = runs[0]
    for run in runs[1:]:
        union = union.unionByName(run)
    return union.groupBy("key").agg(F.sum("docs").alias("docs"))


def dedup_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with text_kept (the lines that stay, joined by newlines), n_lines (before) and n_dropped."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.drop("text_kept", "n_lines", "n_dropped")
    rest = docs.drop("text")
    row = docs.select(
        carried(rest), "text", F.md5(F.concat_ws("\x01", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), text)).alias("_row"),
        F.coalesce(F.xxhash64(F.col("doc_id")), F.lit(0)).alias("_id"),
    )
    row = row.withColumn("_doc", F.when(F.col("row.doc_id").isNull(), F.xxhash64("text")).otherwise(F.col("_id"))).drop("_id")
    keys = materialise(
        row.select("_row", "_doc", F.posexplode(F.transform(F.split(text, "\n", -1), line_key)).alias("pos", "key"))
        .filter("key IS NOT NULL")
        .withColumn("batch", F.pmod("_doc", F.lit(batches)).cast("int")),
        "line-keys",
        ["batch"],
    )
    runs = LineRuns(min_documents, fanout)
    for batch in range(batches):
        # a key counts once a document: distinct rows first, which also evens out hot keys before the shuffle by key
        once = keys.filter(F.col("batch") == batch).groupBy("_doc", "key").agg(F.lit(1).alias("one"))
        runs.add(once.groupBy("key").agg(F.count("one").alias("docs")))
    settled = materialise(runs.settled().select("key"), "line-settled")
    gone = keys.join(settled, "key").select("_row", "pos").distinct().groupBy("_row").agg(F.collect_list("pos").alias("_gone"))
    lines = row.withColumn("_lines", F.split(text, "\n", -1)).drop("text")
    stays = F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone")), lambda i: F.get(F.col("_lines"), i))
    )
    return lines.join(gone, "_row", "left").select(
        "row",
        F.array_join(stays, "\n").alias("text_kept"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    ).select("row.*", "text_kept", "n_lines", "n_dropped")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text_kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (
  SELECT doc_id, line, pos,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE f.key IS NOT NULL))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""
