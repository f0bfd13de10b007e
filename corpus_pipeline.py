"""The corpus pipeline: documents through quality rules, near-dedup, secret redaction, source mixing and tokenization.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it kept, and returns a DataFrame that is written
and read again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm import bpe, minhash, mixing, quality, secrets
from siftwork.llm._shared import documents, settled

#: Near-duplicates here are sets of five-word shingles that are 80 % alike.
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id."""
    return minhash.deduplicated(docs, PERCENT, SHINGLE)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; n_chars follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, a row for each copy."""
    return bpe.digest(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express the dependent rounding and the merges; the tests check every stage against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settled(docs)
    return docs
