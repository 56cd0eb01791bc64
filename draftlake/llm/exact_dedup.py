"""Exact deduplication by a stream with disk-backed keyed state.

A structured stream over the documents' digests keeps, for each digest and without expiry, how many documents
had it and the best one so far: its length, stable identifier, run and content locator (the file it lies in). The
state lives in RocksDB on the executors' disks and, checkpointed, in the shared folder. Documents that hit a
digest seen before are then checked byte by byte; digests that stand for different bytes (collisions) are
settled anew by the bytes themselves. With a ``state_dir`` of its own, a later run goes on from the state of
the earlier ones: documents of earlier runs count, and stay if they're the best; they're known by their digests then, and the byte
check covers the documents of the run. A ``run`` has a name: repeated under its name, after it died or not, it gives the
same result again, as its digests are written once, by one renaming of their folder, and the stream reads each file once.

Cases: a null text counts as empty; among equal texts the longest original stays, then the smallest doc_id,
nulls last; of repeated rows with one doc_id and length exactly one is kept; an empty table gives an empty
result; extra columns are carried along.
"""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import carried, materialise, settings, shared_dir

#: Parts that the byte check splits each digest's documents into.
CHECK_SALTS = 16
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no room set aside on disk
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",  # of all stores of an executor; the rest is on its disk
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _best() -> Column:
    """Orders the documents of a group; the least one stays."""
    return F.struct((-F.col("length")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("run").alias("run"), F.col("locator").alias("locator"))


def stream_digests(digests: DataFrame, path: str, state_dir: str | None = None, max_bytes_per_trigger: int = 64 << 30) -> DataFrame:
    """Runs the stream over the Parquet table at path until it has read all files that are there now.

    Returns one row per digest: digest, group_size, best. With a state_dir the stream goes on where an
    earlier run over the same table stopped.
    """
    spark = digests.sparkSession
    state_dir = state_dir or shared_dir(spark, "dedup-state")
    updates = f"{state_dir}/updates"

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={batch_id}")

    with settings(spark, STATE_CONF):
        seen = (
            spark.readStream.schema(digests.schema).option("maxBytesPerTrigger", str(max_bytes_per_trigger)).parquet(path)
            .groupBy("digest")
            .agg(F.count(F.lit(1)).alias("group_size"), F.min(_best()).alias("best"))
        )
        query = (
            seen.writeStream.outputMode("update").foreachBatch(save)
            .option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    if not query.recentProgress and not state_dir_has_updates(spark, updates):
        return spark.createDataFrame([], seen.schema)
    # a digest's last update is its state
    return spark.read.schema(seen.schema).parquet(updates).groupBy("digest").agg(
        F.max("group_size").alias("group_size"), F.max_by("best", "group_size").alias("best")
    )


def state_dir_has_updates(spark: SparkSession, updates: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(updates)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def write_once(rows: DataFrame, folder: str) -> None:
    """Write rows as folder, unless it's there. Nobody sees a part of it: it's written beside and renamed."""
    spark = rows.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, beside = path(folder), path(f"{folder.rsplit('/', 2)[0]}/pending-{folder.rsplit('/', 1)[1]}")
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(target):
        rows.write.mode("overwrite").parquet(beside.toString())
        store.mkdirs(target.getParent())
        if not store.rename(beside, target):
            raise OSError(f"can't rename {beside.toString()} to {folder}")


def exact_dedup(docs: DataFrame, state_dir: str | None = None, run: str | None = None) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256. A run that's tried again gives its name again."""
    spark = docs.sparkSession
    own = ["keep_id", "group_size", "kept", "text_sha256"]
    docs, run = docs.drop(*own), run or f"{time.time_ns():020d}"
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(carried(docs), "doc_id", normalised(F.col("text")).alias("_text"), F.length(text).alias("_length")).withColumn("_digest", F.sha2("_text", 256))
    state_dir = state_dir.rstrip("/") if state_dir else shared_dir(spark, "dedup-state")
    path = f"{state_dir}/digests"  # the stream's table: each run adds a folder
    write_once(keyed.select(F.col("_digest").alias("digest"), "doc_id", F.col("_length").alias("length"), F.lit(run).alias("run"), F.input_file_name().alias("locator")), f"{path}/of={_named(run)}")
    digests = spark.read.schema("digest string, doc_id " + dict(docs.dtypes)["doc_id"] + ", length int, run string, locator string, of string").parquet(path)
    groups = materialise(stream_digests(digests, path, state_dir), "dedup-groups")

    clashes = materialise(_clashes(keyed, groups), "dedup-clashes")
    joined = keyed.drop("_text").join(groups.select(F.col("digest").alias("_digest"), F.col("group_size"), F.col("best.doc_id").alias("keep_id"), (-F.col("best.shorter")).alias("_keep_length"), F.col("best.run").alias("_keep_run")), "_digest")
    if not clashes.isEmpty():
        joined = _by_bytes(keyed, clashes, run).unionByName(joined.join(clashes, "_digest", "left_anti"))
    is_best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_length") == F.col("_keep_length")) & (F.col("_keep_run") == run)
    # of repeated rows the first stays; the partition holds rows of one digest, doc_id and length
    first = F.row_number().over(Window.partitionBy("_digest", "doc_id", "_length").orderBy("doc_id")) == 1
    return joined.select("row", "keep_id", "group_size", (is_best & first).alias("kept"), F.col("_digest").alias("text_sha256")).select("row.*", *own)


def _named(run: str) -> str:
    """A run's name as a folder's."""
    return hashlib.sha256(run.encode()).hexdigest()[:32]


def _clashes(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """Digests whose documents differ in their bytes: least and greatest text of each digest, compared."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(CHECK_SALTS)).cast("int")
    hits = groups.filter("group_size > 1").select(F.col("digest").alias("_digest"), F.explode(F.sequence(F.lit(0), F.lit(CHECK_SALTS - 1))).alias("_salt"))
    ends = keyed.select("_digest", "_text", salt.alias("_salt")).join(hits, ["_digest", "_salt"]).groupBy("_digest", "_salt").agg(F.min("_text").alias("low"), F.max("_text").alias("high"))
    return ends.groupBy("_digest").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high").select("_digest")


def _by_bytes(keyed: DataFrame, clashes: DataFrame, run: str) -> DataFrame:
    """The documents of clashing digests, grouped by their bytes."""
    hit = keyed.join(clashes, "_digest", "left_semi")
    best = F.min(F.struct((-F.col("_length")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id")))
    groups = hit.groupBy("_digest", "_text").agg(F.count(F.lit(1)).alias("group_size"), best.alias("_b"))
    return hit.join(groups, ["_digest", "_text"]).select("*", F.col("_b.doc_id").alias("keep_id"), (-F.col("_b.shorter")).alias("_keep_length"), F.lit(run).alias("_keep_run")).drop("_text", "_b")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY len DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM k
"""
