"""From raw documents to training shards: each stage works on all that the one before it kept.

Every stage is a function of (spark, docs, sf_dir). All but the last return the columns of
documents; each result is written as Parquet to shared storage and read again, and removed once the
next one is stored.

Defined cases, of all stages: other columns than doc_id, text, source and lang are carried and
never read, whatever their names but those that start with ``__``. Ids may be null or repeated.
An empty table passes every stage as an empty table. Each stage states its own for nulls, empty and
long texts, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, jaccard_join, langid, mixing, sharding
from tessera.llm.scratch import fresh_path, remove


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; texts without a letter, or of no clear language, go.

    Null and empty texts go. Repeated rows are judged alike. If no row tells a language to learn from, all go.
    """
    return langid.accepted(docs, langid.fit_open(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies (five-word shingles, similarity 0.8).

    That of the smallest id stays, a null id last, then the smallest text hash; of rows with one id and text,
    any one. Texts without words link with nothing and stay.
    """
    return jaccard_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts stay, and an empty benchmark removes nothing. Every row is judged by its own text,
    whatever other rows have its id.
    """
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source of its own, the last one. Documents without words are taken as often as
    their hash says. Copies are numbered, so ties part.
    """
    return mixing.apply_mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard and slot.

    Null ids come first; rows with one id stand in the order they are read in. Null text weighs one.
    """
    return sharding.shard_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("shards", shards),
]

#: Language identification has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of all stages applied to documents."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
