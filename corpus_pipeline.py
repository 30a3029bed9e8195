"""The corpus pipeline: quality, near duplicates, benchmark leaks, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread
as the docs of the next.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ripplecast.llm import decontaminate, kd_shard, mixing, quality_knn, simhash_dedup
from ripplecast.llm.common import scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_knn.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kd_shard.shard_documents(docs).select(*docs.columns, "shard", "slot")


STAGES = [("quality", quality), ("near duplicates", near_duplicates), ("benchmark leaks", benchmark_leaks), ("mixing", mixing_weights), ("sharding", sharding)]

#: Nearest-neighbour voting in a latent space has no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir))
    return docs
