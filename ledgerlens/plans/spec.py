"""QuerySpec: one intermediate form for the closed set of question shapes, and its DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHAPES = ("point", "nth", "topn", "max", "min", "count", "multi_year")


@dataclass(frozen=True)
class QuerySpec:
    """shape, metric, filters (all are ANDed; places are ORed), n and direction. ``text_order`` ranks amounts as strings."""

    shape: str
    metric: str = "revenue"
    companies: tuple[str, ...] = ()
    years: tuple[int, ...] = ()
    places: tuple[str, ...] = ()
    ranges: tuple[tuple[str, float | None, float | None], ...] = field(default=())
    n: int = 1
    descending: bool = True
    text_order: bool = False


def predicate(s: QuerySpec) -> Column:
    """The conjunction of a spec's filters; true where it has none."""
    out = F.lit(True)
    if s.companies:
        out &= F.col("company").isin(*s.companies)
    if s.years:
        out &= F.col("year").isin(*s.years) if len(s.years) > 1 else F.col("year") == s.years[0]
    if s.places:
        any_place = F.lit(False)
        for p in s.places:
            any_place |= F.col("place").contains(p)
        out &= any_place
    for metric, low, high in s.ranges:
        if low is not None:
            out &= F.col(metric) > low
        if high is not None:
            out &= F.col(metric) < high
    return out


def order_of(s: QuerySpec) -> list[Column]:
    key = F.col(s.metric).cast("string") if s.text_order else F.col(s.metric)
    return [key.desc_nulls_last() if s.descending else key.asc_nulls_last(), F.col("company"), F.col("year")]


def plan(report: DataFrame, s: QuerySpec) -> DataFrame:
    """report: company, place, industry, year and metrics. Sorting with a limit stays a top-k per task; a count reads no other column."""
    if s.shape not in SHAPES:
        raise ValueError(f"unknown shape {s.shape}")
    rows = report.where(predicate(s))
    if s.shape == "count":
        return rows.agg(F.count("*").alias("n"))
    columns = ["company", "year", s.metric]
    if s.shape == "point":
        return rows.select(*columns)
    rows = rows.where(F.col(s.metric).isNotNull()).select(*columns)
    if s.shape == "multi_year":
        w = Window.partitionBy("year").orderBy(*order_of(s))
        top = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= s.n)
        both = top.groupBy("company").agg(F.count("*").alias("n_years"), (F.sum(s.metric).cast("double") / F.count("*")).alias("mean"))
        return both.where(F.col("n_years") == len(s.years)).select("company", "mean")
    ordered = rows.orderBy(*order_of(s) if s.shape != "min" else order_of(QuerySpec("min", s.metric, descending=False)))
    if s.shape == "nth":
        return ordered.offset(s.n - 1).limit(1)
    return ordered.limit(s.n if s.shape == "topn" else 1)
