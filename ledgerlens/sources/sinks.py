"""Sinks. Replacing writes overwrite, so reruns do not duplicate."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def replace_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def replace_jdbc(df: DataFrame, url: str, name: str, **options: str) -> None:
    df.write.mode("overwrite").options(**options).jdbc(url, name)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def insert_if_absent(new: DataFrame, path: str) -> None:
    """Appends rows that are not in the table yet, each once; nulls are equal to each other."""
    old = new.sparkSession.read.schema(new.schema).parquet(path)
    new.dropDuplicates().alias("new").join(old.alias("old"), reduce(and_, (F.col(f"new.`{c}`").eqNullSafe(F.col(f"old.`{c}`")) for c in new.columns)), "left_anti").write.mode("append").parquet(path)


def answers(df: DataFrame, path: str) -> None:
    """id, question, answer; commas and line breaks leave the answer."""
    df.select("id", "question", F.translate("answer", ",\n", "").alias("answer")).write.mode("overwrite").json(path)


def split_by(df: DataFrame, condition, good: str, bad: str) -> None:
    """Two writes of one frame: rows that meet the condition, and the others (null counts as not meeting)."""
    ok = F.coalesce(condition, F.lit(False))
    df.where(ok).write.mode("overwrite").json(good)
    df.where(~ok).write.mode("overwrite").json(bad)
