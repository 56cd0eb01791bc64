"""Which of many ids occur in which texts: an Aho-Corasick automaton over the ids, in place of a join on ``contains``.

The ids are cut into ``buckets`` by hash, so that an automaton's size is bounded by what a task holds, however many ids there
are. Texts are told apart first, then each goes once to each bucket (not to each id), and a task that has a bucket's texts
builds the bucket's automaton once. The result is pairs that occur; its size is that of the answer.

Cases: null and empty ids and texts match nothing; ids that contain or overlap one another are all found; an id that occurs twice in a text
is one pair; repeated rows are one; matching is by code points, as written; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import shared_folder

IDS_OF_BUCKET = 200_000


def mentions(ids: DataFrame, texts: DataFrame, ids_of_bucket: int = IDS_OF_BUCKET) -> DataFrame:
    """id, text: the pairs of an id (column id) and a text (column text) that contains it."""
    ids = ids.select(F.col("id").cast("string").alias("id")).filter("id <> ''").distinct()
    texts = texts.select("text").filter("text <> ''").distinct()
    buckets = max(1, -(-ids.count() // ids_of_bucket))
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    none = F.lit(None).cast("string")
    rows = ids.select(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"), "id", none.alias("text"), F.lit(0).alias("part"))
    # a bucket's texts are spread over parts of their own, each with the bucket's ids
    parts = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets)
    rows = rows.drop("part").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    spread = texts.select(F.explode(every).alias("bucket"), none.alias("id"), "text", F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int").alias("part"))
    both = rows.select("bucket", "part", "id", "text").unionByName(spread.select("bucket", "part", "id", "text"))
    placed = both.repartition(buckets * parts, "bucket", "part").sortWithinPartitions("bucket", "part", F.col("id").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, automaton, ready = None, None, False
        for batch in batches:
            found_ids, found_texts = [], []
            for bucket, part, id_, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, part) != at:
                    at, automaton, ready = (bucket, part), ahocorasick.Automaton(), False
                if id_ is not None:
                    automaton.add_word(id_, id_)
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                if len(automaton):
                    hits = {hit for _, hit in automaton.iter(text)}
                    found_ids += hits
                    found_texts += [text] * len(hits)
            if found_ids:
                yield pa.RecordBatch.from_arrays([pa.array(found_ids, pa.string()), pa.array(found_texts, pa.string())], ["id", "text"])

    return placed.mapInArrow(run, "id string, text string")


def predictions_of_samples(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """predictions (with path, row and input_images) for each sample (sample_id) that one of their images' paths contains."""
    spark = predictions.sparkSession
    held, schema = shared_folder(spark, "predictions"), predictions.schema
    predictions.write.parquet(held)  # read four times below: what makes them runs once
    predictions = spark.read.schema(schema).parquet(held)
    each = predictions.select("path", "row", F.explode("input_images").alias("text"))
    found = mentions(samples.select(F.col("sample_id").alias("id")), each.select("text"))
    places = each.join(found, "text").select("path", "row", F.col("id").alias("sample_id")).distinct()
    return predictions.join(places, ["path", "row"])
