"""A corpus from raw documents in five stages: toxic documents go, exact and near copies go, sources are mixed
to their weights, and what is left is packed into token sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the
columns of docs. run() writes each stage's result to the shared folder and reads it back for the next.

Cases: null and empty texts are clean, equal to each other, near nothing, of size 0 (the mix takes them as often as their
source's rate says) and one closing id long; null sources are a source of their own; of repeated rows one goes on after
exact deduplication; rows that share a doc_id but not their text stay apart there, and go together in the stage after it;
with no labels to learn from nothing is toxic; other columns are carried along whatever their names; empty tables
give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from draftlake.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from draftlake.llm.shared import materialise

#: Near copies share this percentage of their shingles of so many words; op5's own contract (3 words, 90) is stricter.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs).filter("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_each(docs, words=NEAR_WORDS, percent=NEAR_PERCENT).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest_pieces(packing.pack(docs, packing.default_tokenizer()))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: Neither the kernel machine nor the tokenizer can be said in SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
