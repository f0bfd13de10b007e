"""The queries op1 to op10 and pipeline: each operator over its whole table, and the digest columns that its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftwork.llm import blocks, bpe, htmltext, licenses, minhash, mixing, quality, secrets, spotsigs, suffixes
from siftwork.llm._shared import documents


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(documents(spark, sf_dir))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(documents(spark, sf_dir))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(documents(spark, sf_dir))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(documents(spark, sf_dir))


def op5_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.digest(documents(spark, sf_dir))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(documents(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(documents(spark, sf_dir))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.digest(documents(spark, sf_dir))


def spotsigs_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.links(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cascade(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scans": op1_secret_scans,
        "op2_license_scans": op2_license_scans,
        "op3_source_mixing": op3_source_mixing,
        "op4_minhash_dedup": op4_minhash_dedup,
        "op5_block_dedup": op5_block_dedup,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_spotsigs": op8_spotsigs,
        "spotsigs_links": spotsigs_links,
        "op10_html_extraction": op10_html_extraction,
        "op9_quality_rules": op9_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    from siftwork.llm import sql

    return sql.ORACLES
