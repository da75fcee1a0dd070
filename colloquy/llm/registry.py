"""Queries of the numbered operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bradley_terry, html_extract, maxscore, mixing, ngram_lm, outliers, packing, phrases, pii, simhash, substring, token_counts, variants


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op1_html_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op2_ngram_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(table(spark, sf_dir, "documents"))


def op3_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search_table(table(spark, sf_dir, "embeddings"))


def op4_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bradley_terry.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(table(spark, sf_dir, "documents")).drop("distance")


def op6_pii_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).drop("text")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_toivonen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spellings(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_html_min_cut, op2_ngram_lm_score, op3_maxscore_top_k, op4_bradley_terry_quality, op5_robust_outliers, op6_pii_contexts, op7_substring_dedup,
        op8_simhash_near_dedup, op9_mix_sources, op10_pack_sequences, op11_toivonen_phrases, op12_spelling_variants, op13_token_counts,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_maxscore_top_k": maxscore.ORACLE, "op9_mix_sources": mixing.ORACLE, "op11_toivonen_phrases": phrases.ORACLE}
