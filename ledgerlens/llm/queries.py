"""One query per training-data operator, each over its whole table with production parameters.

No SQL twin is registered: each of these operators hashes, decodes, trains or searches in ways that the comparison
engine's SQL cannot express. ``tests/llm`` holds them against brute force, exact round trips or held-out accuracy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import embeddings, html, langid, lm, mixing, mjpeg, packing, pii, simhash, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mjpeg.store_texts(_table(spark, sf_dir, "documents"))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_lm_scores": op2_lm_scores,
    "op3_language_id": op3_language_id,
    "op4_simhash": op4_simhash,
    "op5_url_filter": op5_url_filter,
    "op6_media_columns": op6_media_columns,
    "op7_mixing": op7_mixing,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_pii_spans": op9_pii_spans,
    "op10_packing": op10_packing,
}
ORACLES: dict[str, str] = {}
