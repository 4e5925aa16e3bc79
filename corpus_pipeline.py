"""A training corpus from raw documents: language ID, exact dedup, near dedup, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clauseq.llm.exact_dedup import keep_first_copies
from clauseq.llm.language_id import keep_identified
from clauseq.llm.ngram_join import keep_one_of_each
from clauseq.llm.packing import pack_default
from clauseq.llm.secret_scan import redact_secrets
from clauseq.llm.staging import staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_default(docs, with_ids=True)


STAGES = [("language", language), ("exact", exact), ("near", near), ("secrets", secrets), ("packing", packing)]

#: The language model, the automaton's spans and the packing are not SQL; tests hold every stage and the whole run against planted cases and plain rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
