"""All registered queries with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.plans import queries_answers, queries_extract, queries_language, queries_metrics, queries_more, queries_retrieval  # noqa: F401  (they register)
from ledgerlens.registry import ORACLES, QUERIES  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["company_year_growth"](spark, sf_dir)
