"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from ledgerlens.catalogue import ORACLES, QUERIES, flagship

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(df):
    def one(v):
        if v is None or str(v) in ("<NA>", "NaT", "nan"):
            return "NULL"
        return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DIR).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_flagship(spark):
    assert flagship(spark, DIR).count() > 0


def test_entry_point_names():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_top_k_is_one_pass(spark):
    plan = QUERIES["topn"](spark, DIR)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
