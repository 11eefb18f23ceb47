"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embedding_dedup, html_extract, jaccard_join, langid, mixing, pii, sharding, token_codes, url_reputation


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = url_reputation.label_outcomes(_table(spark, sf_dir, "labels"))
    judged = url_reputation.judge(_table(spark, sf_dir, "pages"), outcomes)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("mean", 6).alias("mean"), F.round("bound", 6).alias("bound"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.round_trip(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(_table(spark, sf_dir, "documents"))


def pii_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10_pii says without its terms, which SQL can hold."""
    return op10_pii(spark, sf_dir).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_language_id, op3_sharding, op4_url_reputation, op5_html_text, op6_embedding_dedup, op7_token_codes, op8_mixing, op9_jaccard_join, op10_pii, pii_base_columns)}

ORACLES: dict[str, str] = {"op1_decontamination": decontamination.ORACLE, "op3_sharding": sharding.ORACLE, "op4_url_reputation": url_reputation.ORACLE, "op6_embedding_dedup": embedding_dedup.ORACLE, "op8_mixing": mixing.ORACLE, "op9_jaccard_join": jaccard_join.ORACLE, "pii_base_columns": pii.BASE_ORACLE}
