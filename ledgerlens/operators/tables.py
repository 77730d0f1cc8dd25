"""Table rows as arrays of cells: cleaning, stitching, empty columns, key-value lookups, statement rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_cells(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "\n", ""))


def stitch_rows(rows: DataFrame, key: str) -> DataFrame:
    """A row whose first cell is null continues the row before it, cell by cell."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    anchored = rows.withColumn("anchor", F.sum(F.when(F.col("cells")[0].isNotNull(), 1).otherwise(0)).over(w))
    cell = anchored.select(key, "anchor", "pos", F.posexplode("cells").alias("col", "cell"))
    joined = cell.groupBy(key, "anchor", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("cell", F.lit("")).alias("c")))), lambda x: x["c"]), "").alias("cell"))
    return joined.groupBy(key, "anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "cell"))), lambda x: x["cell"]).alias("cells"))


def drop_empty_columns(rows: DataFrame, key: str) -> DataFrame:
    """Cells of columns that hold text in some row of their table, in order."""
    cell = rows.select(key, "pos", F.posexplode("cells").alias("col", "cell"))
    used = cell.groupBy(key, "col").agg(F.max(F.coalesce("cell", F.lit("")) != "").alias("u")).where("u")
    kept = cell.join(used.select(key, "col"), [key, "col"], "left_semi")
    return kept.groupBy(key, "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce("cell", F.lit("")).alias("c")))), lambda x: x["c"]).alias("cells"))


def value_beside(cells: Column, key_pattern: str, no_han: bool = False) -> Column:
    """The first cell of a row that names the key which is neither the key nor blank (nor, if so asked, Chinese)."""
    fits = lambda c: ~c.rlike(key_pattern) & (F.trim(c) != "") & (~c.rlike(r"\p{IsHan}") if no_han else F.lit(True))
    return F.when(F.exists(cells, lambda c: c.rlike(key_pattern)), F.get(F.filter(cells, fits), F.lit(0)))


def first_values(facts: DataFrame, *by: str) -> DataFrame:
    """First value by position for each key; blank as 无."""
    value = F.min_by(F.struct("value"), "pos")["value"]
    return facts.groupBy(*by).agg(F.when(F.trim(value) == "", F.lit("无")).otherwise(value).alias("value"))
