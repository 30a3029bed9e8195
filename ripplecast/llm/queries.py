"""The opN_ queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ripplecast.llm import brown_lm, chat_format, decontaminate, hilbert_ann, kd_shard, mixing, quality_knn, secret_scan, simhash_dedup, toxicity
from ripplecast.llm import sql
from ripplecast.llm.common import table

PROBE = "\\### Assistant: </turn> ok"


def op1_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op3_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.search(table(spark, sf_dir, "embeddings"))


def op4_kd_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shard.report(table(spark, sf_dir, "documents"))


def op5_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.report(table(spark, sf_dir, "documents"))


def op8_winnow_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_windows(rows.unionByName(probe)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_crf_toxicity, op2_secret_scan, op3_hilbert_ann, op4_kd_shard, op5_simhash_bk, op6_knn_quality, op7_brown_lm, op8_winnow_decontaminate, op9_mix_sources, op10_chat_windows)}


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": sql.secrets(), "op8_winnow_decontaminate": sql.leaks(), "op9_mix_sources": sql.mixing(), "op10_chat_windows": sql.chat(PROBE)}
