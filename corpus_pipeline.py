"""A training-data pipeline over `documents`: filter, deduplicate, decontaminate, redact, mix.

Each stage takes (spark, docs, sf_dir), works on all rows it gets and returns a DataFrame with the columns of documents; the
last one returns the mix, each document as often as it is taken, with the number of the copy. The stages are written and
read again between each other, so none is computed twice. Rows with null ids or texts, repeated rows and empty tables are
as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import decontam, mixing, near_dup, quality_rules, secret_scan
from cadenza.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or lie beyond a fence of their language and source, go."""
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more), the document with the smallest id stays."""
    return near_dup.drop_duplicates(docs, rule=near_dup.FIVE_WORDS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"), mode="documents")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: one row for each copy that is taken."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality),
    ("minhash near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("mixing to target weights", mix),
]

#: Near-duplicates, trained models and span cuts have no SQL; tests hold the stages against plain-Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return docs
