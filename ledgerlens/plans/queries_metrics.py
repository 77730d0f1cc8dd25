"""Queries on company-year facts, joins, audits and ranking shapes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.operators import metrics as M
from ledgerlens.plans.spec import QuerySpec, plan
from ledgerlens.registry import query, table

CY = """cy AS (SELECT c_name AS company, c_mktsegment AS industry, n_name AS place, CAST(year(o_orderdate) AS INT) AS year,
 SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue, COUNT(*) AS n_orders
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3, 4)"""
ITEMS = """items AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS year, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gross,
 CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS net,
 CAST(SUM(CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(5,2))) * CAST(l_tax AS DECIMAL(5,2)) AS DECIMAL(38,6))) AS DOUBLE) AS tax,
 CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, CAST(COUNT(*) AS DOUBLE) AS n_lines
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def cy(spark: SparkSession, d: str) -> DataFrame:
    return M.company_year(table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation"))


def money(c: str):
    return F.col(c).cast("double").alias(c)


@query(f"""WITH {CY}, g AS (SELECT *, SUM(revenue) OVER (PARTITION BY company ORDER BY year RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS last,
 CAST(SUM(revenue) OVER (PARTITION BY year, industry) AS DOUBLE) / COUNT(*) OVER (PARTITION BY year, industry) AS industry_avg,
 RANK() OVER (PARTITION BY year ORDER BY revenue DESC) AS r, COUNT(*) OVER (PARTITION BY year, revenue) AS ties FROM cy)
SELECT company, industry, year, CAST(revenue AS DOUBLE) AS revenue, CAST(last AS DOUBLE) AS last_revenue,
 CASE WHEN last <> 0 THEN (CAST(revenue AS DOUBLE) - CAST(last AS DOUBLE)) / CAST(last AS DOUBLE) * 100 END AS growth, industry_avg,
 CAST(TRUNC(r + (ties - 1) / 2.0) AS INT) AS year_rank FROM g""")
def company_year_growth(spark, d):
    x = cy(spark, d).withColumn("last", M.prior("revenue"))
    x = M.average_rank(M.group_mean(x, "revenue", ["year", "industry"], "industry_avg"), "revenue", ["year"], "year_rank")
    return x.select("company", "industry", "year", money("revenue"), F.col("last").cast("double").alias("last_revenue"), M.growth(F.col("revenue"), F.col("last")).alias("growth"), "industry_avg", "year_rank")


@query(f"WITH {CY} SELECT year, industry, CAST(SUM(revenue) AS DOUBLE) / COUNT(*) AS industry_avg, COUNT(*) AS n FROM cy GROUP BY 1, 2")
def industry_average(spark, d):
    return cy(spark, d).groupBy("year", "industry").agg((F.sum("revenue").cast("double") / F.count("*")).alias("industry_avg"), F.count("*").alias("n"))


@query(f"WITH {CY}, r AS (SELECT company, year, n_orders, RANK() OVER (PARTITION BY year ORDER BY n_orders DESC) AS r, COUNT(*) OVER (PARTITION BY year, n_orders) AS t FROM cy) SELECT company, year, n_orders, CAST(TRUNC(r + (t - 1) / 2.0) AS INT) AS year_rank FROM r")
def company_rank_avg_ties(spark, d):
    return M.average_rank(cy(spark, d), "n_orders", ["year"], "year_rank").select("company", "year", "n_orders", "year_rank")


@query(f"WITH {CY}, r AS (SELECT company, industry, year, CAST(revenue AS DOUBLE) AS revenue, RANK() OVER (PARTITION BY year, industry ORDER BY revenue DESC) AS r, COUNT(*) OVER (PARTITION BY year, industry, revenue) AS t FROM cy) SELECT company, industry, year, revenue, CAST(TRUNC(r + (t - 1) / 2.0) AS INT) AS industry_rank FROM r")
def industry_rank(spark, d):
    return M.average_rank(cy(spark, d), "revenue", ["year", "industry"], "industry_rank").select("company", "industry", "year", money("revenue"), "industry_rank")


_FLAGS = [("A", "F"), ("A", "O"), ("N", "F"), ("N", "O"), ("R", "F"), ("R", "O")]
_WIDE = ", ".join(f"CAST(SUM(CASE WHEN l_returnflag = '{a}' AND l_linestatus = '{b}' AND l_quantity > 47 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS {a.lower()}_{b.lower()}" for a, b in _FLAGS)


def wide_report(spark, d) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").cast("int").alias("year"), F.lower(F.concat_ws("_", "l_returnflag", "l_linestatus")).alias("item"), F.when(F.col("l_quantity") > 47, F.col("l_extendedprice").cast(M.MONEY)).alias("v"))
    names = [f"{a.lower()}_{b.lower()}" for a, b in _FLAGS]
    return x.groupBy("l_suppkey", "year").pivot("item", names).agg(F.sum("v")).select("l_suppkey", "year", *[money(n) for n in names])


@query(f"SELECT l_suppkey, CAST(year(l_shipdate) AS INT) AS year, {_WIDE} FROM lineitem GROUP BY 1, 2")
def fin_report_wide(spark, d):
    return wide_report(spark, d)


@query("SELECT o_orderkey, c_name, n_name, r_name, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def merge_four_tables(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return x.select("o_orderkey", "c_name", "n_name", "r_name", "o_totalprice")


@query("WITH p AS (SELECT p_partkey, CASE WHEN p_size < 5 THEN '其他' ELSE p_brand || '--' || p_type || '--' || p_name END AS raw FROM part) SELECT p_partkey, CASE WHEN raw = '其他' THEN raw ELSE split_part(raw, '--', 1) || '--' || split_part(raw, '--', 2) END AS industry FROM p")
def industry_two_level(spark, d):
    raw = F.when(F.col("p_size") < 5, F.lit("其他")).otherwise(F.concat_ws("--", "p_brand", "p_type", "p_name"))
    x = table(spark, d, "part").select("p_partkey", raw.alias("raw"))
    return x.select("p_partkey", F.when(F.col("raw") == "其他", F.col("raw")).otherwise(F.concat_ws("--", F.slice(F.split("raw", "--"), 1, 2))).alias("industry"))


def _sql_ratio(formula: str) -> str:
    named = re.sub(r"([^\W\d]\w*)", r'"\1"', formula)
    over, _, under = named.rpartition("/") if not named.endswith(")") else named.partition("/")
    return f"{over} / NULLIF({under}, 0)"


_ITEM_SUMS = ", ".join(f"CAST(SUM(CASE WHEN l_partkey % {len(M.RATIO_ITEMS)} = {i} THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS \"{n}\"" for i, n in enumerate(M.RATIO_ITEMS))
_RATIOS = f"items AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INT) AS year, {_ITEM_SUMS} FROM lineitem GROUP BY 1, 2)"


def ratio_items(spark, d) -> DataFrame:
    """One column per item of the catalogue for each supplier's year; a line's part says which item it books to."""
    item = F.element_at(F.array(*map(F.lit, M.RATIO_ITEMS)), (F.col("l_partkey") % len(M.RATIO_ITEMS) + 1).cast("int"))
    x = table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").cast("int").alias("year"), item.alias("item"), F.col("l_extendedprice").cast(M.MONEY).alias("v"))
    wide = x.groupBy("l_suppkey", "year").pivot("item", list(M.RATIO_ITEMS)).agg(F.sum("v"))
    return wide.select("l_suppkey", "year", *[F.col(f"`{n}`").cast("double").alias(n) for n in M.RATIO_ITEMS])


@query(f"WITH {_RATIOS} SELECT l_suppkey, year, " + ", ".join(f'{_sql_ratio(f)} AS "{k}"' for k, f in M.RATIOS.items()) + " FROM items")
def ratio_catalogue(spark, d):
    return ratio_items(spark, d).select("l_suppkey", "year", *[M.compile_formula(f).alias(k) for k, f in M.RATIOS.items()])


@query(f"WITH {ITEMS} SELECT o_custkey, year, (gross - net) / NULLIF(gross, 0) AS discount_rate, tax / NULLIF(net, 0) AS tax_rate, gross / NULLIF(quantity, 0) AS unit_price FROM items")
def formula_over_items(spark, d):
    x = M.items_of(table(spark, d, "lineitem"), table(spark, d, "orders"))
    formulas = {"discount_rate": "(gross - net) / gross", "tax_rate": "tax / net", "unit_price": "gross / quantity"}
    return x.select("o_custkey", "year", *[M.compile_formula(f).alias(k) for k, f in formulas.items()])


@query(f"WITH {CY}, p AS (SELECT a.company, a.year, CAST(a.revenue AS DOUBLE) AS v0, CAST(b.revenue AS DOUBLE) AS v1, b.company IS NOT NULL AS has FROM cy a LEFT JOIN cy b ON a.company = b.company AND a.year = b.year + 1) SELECT company, year, v0 / NULLIF(v1, 0) AS value, CASE WHEN NOT has THEN -4 WHEN v1 = 0 THEN -1 ELSE 0 END AS status FROM p")
def ratio_with_prior_year(spark, d):
    x = cy(spark, d).select("company", "year", money("revenue"))
    last = x.select("company", (F.col("year") + 1).alias("year"), F.col("revenue").alias("v1"), F.lit(True).alias("has"))
    x = x.withColumnRenamed("revenue", "v0").join(last, ["company", "year"], "left")
    return x.select("company", "year", M.compile_formula("{v0}/{v1}").alias("value"), F.when(F.col("has").isNull(), -4).when(F.col("v1") == 0, -1).otherwise(0).alias("status"))


ALIASES = [("metal", 1, "PROMO"), ("metal", 2, "STANDARD"), ("metal", 3, "ECONOMY"), ("paper", 1, "MEDIUM"), ("paper", 2, "SMALL"), ("paper", 3, "LARGE")]
_ALIAS_SQL = ", ".join(f"('{a}', {p}, '{b}')" for a, p, b in ALIASES)


@query(f"""WITH al(canonical, prio, alias) AS (VALUES {_ALIAS_SQL}), f AS (SELECT p_brand, upper(split_part(p_type, ' ', 1)) AS item, SUM(CAST(p_retailprice AS DECIMAL(18,2))) AS v FROM part GROUP BY 1, 2),
 j AS (SELECT p_brand, canonical, prio, v, row_number() OVER (PARTITION BY p_brand, canonical ORDER BY prio) AS r FROM f JOIN al ON item = alias) SELECT p_brand, canonical, CAST(v AS DOUBLE) AS value FROM j WHERE r = 1""")
def alias_fallback(spark, d):
    dim = spark.createDataFrame(ALIASES, "canonical string, prio int, item string")
    f = table(spark, d, "part").groupBy("p_brand", F.upper(F.split("p_type", " ")[0]).alias("item")).agg(F.sum(F.col("p_retailprice").cast(M.MONEY)).alias("v"))
    return f.join(F.broadcast(dim), "item").groupBy("p_brand", "canonical").agg(F.min_by("v", "prio").cast("double").alias("value"))  # the dimension is six rows


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE regexp_matches(c_name, 'CUSTOMER#0*1[0-9]$', 'i')")
def point_lookup_regex_ci(spark, d):
    return table(spark, d, "customer").where(F.col("c_name").rlike("(?i)CUSTOMER#0*1[0-9]$")).select("c_custkey", "c_name", "c_acctbal")


@query(f"WITH {CY} SELECT COUNT(*) AS n FROM cy WHERE year = 1997 AND (contains(place, 'NATION_1') OR contains(place, 'NATION_2')) AND revenue > 100000 AND revenue < 900000")
def place_or_filter_count(spark, d):
    return plan(cy(spark, d), QuerySpec("count", years=(1997,), places=("NATION_1", "NATION_2"), ranges=(("revenue", 100000, 900000),)))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000.0 AND o_totalprice < 300000.0")
def range_filter_units(spark, d):
    from ledgerlens.functions.numbers import scale

    low, high = scale("20万"), scale("30万")
    return table(spark, d, "orders").where((F.col("o_totalprice") > low) & (F.col("o_totalprice") < high)).select("o_orderkey", "o_totalprice")


def _shape(sql: str, **spec):
    def make(name):
        def f(spark, d):
            return plan(cy(spark, d), QuerySpec(**spec)).withColumn("revenue", F.col("revenue").cast("double"))

        f.__name__ = name
        query(f"WITH {CY} SELECT company, year, CAST(revenue AS DOUBLE) AS revenue FROM cy {sql}")(f)

    return make


_shape("WHERE year = 1996 ORDER BY cy.revenue DESC, company LIMIT 1", shape="max", years=(1996,))("top1")
_shape("WHERE year = 1996 ORDER BY cy.revenue DESC, company LIMIT 10", shape="topn", years=(1996,), n=10)("topn")
_shape("WHERE year = 1996 ORDER BY cy.revenue DESC, company LIMIT 1 OFFSET 4", shape="nth", years=(1996,), n=5)("nth")
_shape("WHERE year = 1996 ORDER BY cy.revenue, company LIMIT 1", shape="min", years=(1996,))("bottom1")
_shape("WHERE year = 1996 ORDER BY CAST(cy.revenue AS VARCHAR) DESC, company LIMIT 4", shape="topn", years=(1996,), n=4, text_order=True)("topn_text_order")
_shape("WHERE year IN (1995, 1996) AND company IN ('Customer#000000001', 'Customer#000000002')", shape="point", years=(1995, 1996), companies=("Customer#000000001", "Customer#000000002"))("point_lookup")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL AND o_totalprice != 1.0 ORDER BY o_totalprice, o_orderkey LIMIT 5")
def sentinel_guard(spark, d):
    from ledgerlens.functions.text import guard_sentinel

    table(spark, d, "orders").createOrReplaceTempView("ll_orders")
    return spark.sql(guard_sentinel("SELECT o_orderkey, o_totalprice FROM ll_orders WHERE o_totalprice IS NOT NULL ORDER BY o_totalprice, o_orderkey LIMIT 5"))


@query(f"WITH {CY} SELECT year, COUNT(*) AS n, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM cy WHERE year BETWEEN 1996 AND 1998 GROUP BY 1")
def between_years(spark, d):
    return cy(spark, d).where(F.col("year").between(1996, 1998)).groupBy("year").agg(F.count("*").alias("n"), F.sum("revenue").cast("double").alias("revenue"))


@query(f"WITH {CY}, r AS (SELECT company, year, revenue, row_number() OVER (PARTITION BY year ORDER BY revenue DESC, company) AS r FROM cy WHERE year IN (1996, 1997)) SELECT company, CAST(SUM(revenue) AS DOUBLE) / COUNT(*) AS mean FROM r WHERE r <= 200 GROUP BY 1 HAVING COUNT(*) = 2")
def multi_year_topk_intersection(spark, d):
    return plan(cy(spark, d), QuerySpec("multi_year", years=(1996, 1997), n=200))


@query("WITH p AS (SELECT o_custkey, year(o_orderdate) AS y, MIN(o_orderpriority) AS p FROM orders GROUP BY 1, 2) SELECT o_custkey, CASE WHEN COUNT(DISTINCT p) = 1 THEN '相同' ELSE '不相同' END AS verdict, COUNT(*) AS n_years FROM p GROUP BY 1")
def multi_year_same_value(spark, d):
    p = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.min("o_orderpriority").alias("p"))
    same = F.min("p") == F.max("p")  # one pass, no distinct
    return p.groupBy("o_custkey").agg(F.when(same, F.lit("相同")).otherwise(F.lit("不相同")).alias("verdict"), F.count("*").alias("n_years"))


_NULLS = " UNION ALL ".join(f"SELECT '{a.lower()}_{b.lower()}' AS item, COUNT(*) FILTER (WHERE {a.lower()}_{b.lower()} IS NULL) AS n_null, COUNT(*) AS n FROM w" for a, b in _FLAGS)
_W = f"w AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INT) AS year, {_WIDE} FROM lineitem GROUP BY 1, 2)"


def _long(w: DataFrame) -> DataFrame:
    return w.unpivot(["l_suppkey", "year"], [f"{a.lower()}_{b.lower()}" for a, b in _FLAGS], "item", "v")


@query(f"WITH {_W} SELECT item, n_null, n FROM ({_NULLS})")
def null_audit(spark, d):
    return _long(wide_report(spark, d)).groupBy("item").agg(F.count_if(F.col("v").isNull()).alias("n_null"), F.count("*").alias("n"))


@query(f"WITH {_W}, u AS (" + " UNION ALL ".join(f"SELECT l_suppkey, year, '{a.lower()}_{b.lower()}' AS item FROM w WHERE {a.lower()}_{b.lower()} IS NULL" for a, b in _FLAGS) + ") SELECT *, CAST(row_number() OVER (PARTITION BY item, year ORDER BY l_suppkey) AS INT) AS ordinal FROM u")
def badcase_rows(spark, d):
    bad = _long(wide_report(spark, d)).where("v is null").select("l_suppkey", "year", "item")
    return bad.withColumn("ordinal", F.row_number().over(Window.partitionBy("item", "year").orderBy("l_suppkey")))


_ANY = " OR ".join(f"{a.lower()}_{b.lower()} IS NULL" for a, b in _FLAGS)


@query(f"WITH {_W} SELECT l_suppkey, year, ({_ANY}) AS has_null FROM w")
def rows_with_any_null(spark, d):
    names = [f"{a.lower()}_{b.lower()}" for a, b in _FLAGS]
    return wide_report(spark, d).select("l_suppkey", "year", reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names]).alias("has_null"))


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v FROM (SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS v FROM customer WHERE c_mktsegment <> 'BUILDING') a FULL JOIN (SELECT c_custkey AS k, 'text:' || c_name AS v FROM customer WHERE c_acctbal < 5000) b ON a.k = b.k")
def merge_fill_missing(spark, d):
    c = table(spark, d, "customer")
    a = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("v"))
    b = c.where("c_acctbal < 5000").select(F.col("c_custkey").alias("k"), F.concat(F.lit("text:"), "c_name").alias("v2"))
    return a.join(b, "k", "full").select("k", F.coalesce("v", "v2").alias("v"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1996)")
def anti_keys(spark, d):
    o = table(spark, d, "orders").where((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")))
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) IN (1996, 1997))")
def semi_company_years(spark, d):
    years = F.year("o_orderdate").isin(1996, 1997)
    return table(spark, d, "customer").join(table(spark, d, "orders").where(years), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT source, lang, doc_id FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedup_first_wins(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT DISTINCT role, text FROM conversations")
def dedup_full_record(spark, d):
    return table(spark, d, "conversations").select("role", "text").dropDuplicates()


@query("SELECT text FROM conversations WHERE role = 'assistant' GROUP BY 1 EXCEPT SELECT text FROM conversations WHERE role <> 'assistant'")
def insert_if_absent(spark, d):
    c = table(spark, d, "conversations")
    new, old = (c.where(x).select("text") for x in ("role = 'assistant'", "role <> 'assistant'"))
    return new.dropDuplicates().join(old, "text", "left_anti")


@query("SELECT l_partkey, max_by(l_shipmode_like, (l_orderkey, l_linenumber)) AS last_value FROM (SELECT l_partkey, l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN CAST(l_quantity AS VARCHAR) END AS l_shipmode_like FROM lineitem) WHERE l_shipmode_like IS NOT NULL GROUP BY 1")
def merge_last_non_null(spark, d):
    x = table(spark, d, "lineitem").where("l_quantity > 25")
    return x.groupBy("l_partkey").agg(F.max_by(F.col("l_quantity").cast("string"), F.struct("l_orderkey", "l_linenumber")).alias("last_value"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, COUNT(*) AS n FROM events GROUP BY 1, 2")
def jsonl_parse(spark, d):
    return table(spark, d, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("SELECT event_type, date_trunc('day', ts) AS day, COUNT(*) AS n, COUNT(DISTINCT user_id) AS n_users FROM events GROUP BY 1, 2")
def event_window_counts(spark, d):
    w = table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return w.groupBy("event_type", "day").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@query(f"WITH {CY}, a AS (SELECT company FROM cy WHERE year = 1996), b AS (SELECT company FROM cy WHERE year = 1997) SELECT 'union' AS op, COUNT(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', COUNT(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', COUNT(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def year_set_operations(spark, d):
    flags = cy(spark, d).where("year in (1996, 1997)").groupBy("company").agg(F.bool_or(F.col("year") == 1996).alias("a"), F.bool_or(F.col("year") == 1997).alias("b"))
    n = flags.agg(F.count("*").alias("union"), F.count_if(F.col("a") & F.col("b")).alias("intersect"), F.count_if(F.col("a") & ~F.col("b")).alias("except"))
    return n.unpivot([], ["union", "intersect", "except"], "op", "n")  # one pass for the three


@query("SELECT status, COUNT(*) AS n FROM (SELECT CASE WHEN l_discount = 0 THEN -1 WHEN l_tax = 0 THEN -2 WHEN l_quantity > 45 THEN -3 ELSE 0 END AS status FROM lineitem) GROUP BY 1")
def status_counters(spark, d):
    s = F.when(F.col("l_discount") == 0, -1).when(F.col("l_tax") == 0, -2).when(F.col("l_quantity") > 45, -3).otherwise(0)
    return table(spark, d, "lineitem").groupBy(s.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT 'zero_discount' AS error, l_orderkey, l_linenumber FROM lineitem WHERE l_discount = 0 AND l_tax = 0 UNION ALL SELECT 'large', l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 50 AND NOT (l_discount = 0 AND l_tax = 0)")
def error_side_output(spark, d):
    kind = F.when((F.col("l_discount") == 0) & (F.col("l_tax") == 0), F.lit("zero_discount")).when(F.col("l_quantity") == 50, F.lit("large"))
    return table(spark, d, "lineitem").select(kind.alias("error"), "l_orderkey", "l_linenumber").where("error is not null")


@query("SELECT DISTINCT c_name AS company FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000")
def distinct_companies(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000").select("o_custkey")
    return table(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_name").alias("company")).distinct()


@query(f"WITH {CY} SELECT coalesce(cy.year, -1) AS year, coalesce(cy.place, 'all') AS place, CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(GROUPING(cy.place) AS INT) AS is_total FROM cy GROUP BY ROLLUP (cy.year, cy.place)")
def rollup_year_place(spark, d):
    r = cy(spark, d).rollup("year", "place").agg(F.sum("revenue").cast("double").alias("revenue"), F.grouping("place").cast("int").alias("is_total"))
    return r.withColumns({"year": F.coalesce("year", F.lit(-1)), "place": F.coalesce("place", F.lit("all"))})
