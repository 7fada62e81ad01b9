"""The queries of the training-data operators: op1 to op13 over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontaminate, fill_middle, fingerprints, licenses, near_dedup, packing, quality, secrets, spelling, sql, substring_dedup, tokens, toxicity
from factloom.llm.common import shared_path, table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a cache of its own: with the vocabulary's shared one a second run over the same texts encodes nothing, and its figures say nothing
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), shared_path(spark, "token-cache"))


def op6_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op8_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), pad=50256)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.rearrange(table(spark, sf_dir, "documents")))


QUERIES = (
    op1_secret_scans,
    op2_toxicity,
    op3_document_fingerprints,
    op4_benchmark_decontamination,
    op5_token_counts,
    op6_bpe_encoding,
    op7_minhash_near_dedup,
    op8_token_packing,
    op9_substring_dedup,
    op10_quality_classifier,
    op11_spelling_variants,
    op12_license_scans,
    op13_fill_in_middle,
)


def queries() -> dict[str, Callable]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL twins of op7, op9, op11 and op13; the others need a network, a tokenizer, signatures or a method's own spans, and are tested in tests/llm."""
    return dict(sql.ORACLE)
