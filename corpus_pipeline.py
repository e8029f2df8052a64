"""A corpus pipeline: quality rules, language, near copies, repeated passages, packing.

Every stage takes all documents that its predecessor kept; all but the last return the columns of
``documents``. Each result is written to the shared folder and read again."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import common, langid, nearcopies, outliers, packing, queries, substring


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no robust outliers of their language and source."""
    return outliers.keep(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognized."""
    return langid.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word Jaccard similarity of at least 0.8, that with
    the least doc_id."""
    return nearcopies.keep_first(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that start earlier in the corpus."""
    return substring.remove(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows."""
    return packing.digest(packing.pack(docs, queries.WORDS, end_id=1), queries.WORDS)


STAGES = [("quality_rules", quality), ("language_id", language), ("simhash_near_dedup", near_copies), ("substring_dedup", passages), ("packing", pack)]
#: SQL can express neither the robust estimates nor the trained model; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return docs
