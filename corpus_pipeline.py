"""Documents to training shards: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, folder) and returns a DataFrame; run() writes every stage's result to the shared folder and
rereads it as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, langid, mixing, sharding, simhash
from ledgerline.llm.common import crc_of_id, saved, small_batches
from ledgerline.llm.queries import shard_columns


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language is recognised."""
    small_batches(spark)
    return langid.keep_identified(docs, docs.where(crc_of_id() % 4 != 2))


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return simhash.keep_one_of_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    small_batches(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents repeated and left out by the weights of their sources."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents with their shard and slot; where a column of docs has such a name, the new one gets a free one."""
    return shard_columns(sharding.assign(docs), docs.columns)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: SimHash components and centroids are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
