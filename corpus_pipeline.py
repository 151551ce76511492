"""A training corpus from raw documents: quality, near duplicates, decontamination, mixing, shards.

Every stage takes (spark, docs, folder) and returns the documents that it keeps, with all their columns; the
last one adds the place of each document. Stages work on all that their predecessor kept, and on any
extra columns by passing them through. The mixing stage repeats documents of small sources; it drops none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, mixing, ngram_join, quality, shards
from tidewatch.llm.common import read
from tidewatch.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return quality.judged(docs, read(spark, folder, "labels")).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return decontaminate.without_leaks(docs, read(spark, folder, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return mixing.mixed(docs).select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents with size, shard and slot; those names are taken from the shards where they clash."""
    placed = shards.placed(docs)
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("size", "shard", "slot")]
    return placed.select(*kept, "size", "shard", "slot")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mixing),
    ("sharding", sharding),
]
# MinHash, templates and hashed orders have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, folder)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
