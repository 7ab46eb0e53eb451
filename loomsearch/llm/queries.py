"""The registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bloom_lm, kk_sharding, line_crf, packing, pii_tagger, sentence_spans, simhash_forest, toxicity, url_filter, winnowing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kk_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kk_sharding.sharded(table(spark, sf_dir, "documents"))


def op2_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.scored(table(spark, sf_dir, "documents"))


def op3_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_tagger.tagged(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filtered(table(spark, sf_dir, "pages"))


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.retained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.changed(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rejected(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op10_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kk_sharding": op1_kk_sharding,
    "op2_bloom_lm": op2_bloom_lm,
    "op3_pii_tagger": op3_pii_tagger,
    "op4_url_filter": op4_url_filter,
    "op5_line_crf": op5_line_crf,
    "op6_sentence_spans": op6_sentence_spans,
    "op7_toxicity": op7_toxicity,
    "op8_winnowing": op8_winnowing,
    "op9_simhash_forest": op9_simhash_forest,
    "op10_residual_packing": op10_residual_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op6_sentence_spans": sentence_spans.SQL,
    "op7_toxicity": toxicity.SQL,
    "op8_winnowing": winnowing.SQL,
}
