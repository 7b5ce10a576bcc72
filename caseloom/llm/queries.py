"""The queries opN_<name>, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, divergence, exact_dedup, near_dedup, packing, pieces, quality, resampling, sharding, suffix_dedup, toxicity, url_filter, warc
from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op1(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op3(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), words=2, percent=80)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op5(table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.op10(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_sharding, op2_url_filter, op3_toxicity, op4_minhash, op5_warc, op6_suffix_dedup, op7_quality_rules, op8_exact_dedup,
        op9_byte_bpe, op10_packing, op11_pieces, op12_divergence, op13_resampling,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_minhash": near_dedup.oracle_sql(words=2, percent=80),
        "op5_warc": warc.ORACLE_SQL,
        "op6_suffix_dedup": suffix_dedup.ORACLE_SQL,
        "op8_exact_dedup": exact_dedup.ORACLE_SQL,
        "op12_divergence": divergence.ORACLE_SQL,
        "op13_resampling": resampling.ORACLE_SQL,
    }
