"""Smaller operators: gated lookups, overrides, zips, maps, rendering, splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import answers as A
from ledgerlens.operators import retrieval as R
from ledgerlens.operators import tables as T
from ledgerlens.plans.queries_extract import _ROWS, LINES, cell_rows
from ledgerlens.plans.queries_language import _Q, questions
from ledgerlens.plans.queries_metrics import CY, cy
from ledgerlens.registry import query, table


@query(f"""WITH {LINES}, {_ROWS}, g AS (SELECT *, MIN(CASE WHEN len(cells) > 3 THEN pos END) OVER (PARTITION BY doc_id) AS gate FROM r)
 SELECT doc_id, pos, list_filter(cells, lambda c: NOT regexp_matches(c, 'th') AND trim(c) <> '')[1] AS value FROM g WHERE pos > gate AND len(list_filter(cells, lambda c: regexp_matches(c, 'th'))) > 0""")
def gated_cell_lookup(spark, d):
    """Key-value lookups only below the row that opens the gate."""
    gate = F.min(F.when(F.size("cells") > 3, F.col("pos"))).over(Window.partitionBy("doc_id"))
    rows = cell_rows(spark, d).withColumn("gate", gate).where((F.col("pos") > F.col("gate")) & F.exists("cells", lambda c: c.rlike("th")))
    return rows.select("doc_id", "pos", T.value_beside(F.col("cells"), "th").alias("value"))


@query("SELECT conv_id, coalesce(arg_min(c, turn) FILTER (WHERE c <> 2), 2) AS class FROM (SELECT conv_id, turn, length(text) % 4 AS c FROM conversations) GROUP BY 1")
def first_class_override(spark, d):
    c = F.length("text") % 4
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.coalesce(F.min_by(F.when(c != 2, c), F.when(c != 2, F.col("turn"))), F.lit(2)).cast("long").alias("class"))


@query("SELECT conv_id, turn, CAST(i AS INT) AS i, w, n FROM (SELECT conv_id, turn, generate_subscripts(string_split(text, ' '), 1) - 1 AS i, unnest(string_split(text, ' ')) AS w, length(unnest(string_split(text, ' '))) AS n FROM conversations)")
def zip_parallel_lists(spark, d):
    w = F.split("text", " ")
    x = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.arrays_zip(w.alias("w"), F.transform(w, lambda t: F.length(t)).alias("n"))).alias("i", "z"))
    return x.select("conv_id", "turn", "i", F.col("z.w").alias("w"), F.col("z.n").cast("long").alias("n"))


@query(f"WITH {CY} SELECT year, string_agg(company || ', ' || CAST(n_orders AS VARCHAR), '; ' ORDER BY company) AS rows FROM cy WHERE n_orders >= 7 GROUP BY 1")
def result_stringify(spark, d):
    cells = F.concat_ws(", ", "company", F.col("n_orders").cast("string"))
    return cy(spark, d).where("n_orders >= 7").groupBy("year").agg(F.array_join(F.array_sort(F.collect_list(cells)), "; ").alias("rows"))


@query("WITH p AS (SELECT o_custkey, year(o_orderdate) AS y, MIN(o_orderpriority) AS p FROM orders GROUP BY 1, 2) SELECT o_custkey, string_agg(CAST(y AS VARCHAR) || '年是' || p, '，' ORDER BY y) || '，' || CASE WHEN MIN(p) = MAX(p) THEN '相同' ELSE '不相同' END || '。' AS answer FROM p WHERE y IN (1995, 1996, 1997) GROUP BY 1")
def multi_year_comparison_answer(spark, d):
    p = table(spark, d, "orders").withColumn("y", F.year("o_orderdate")).where("y in (1995, 1996, 1997)").groupBy("o_custkey", "y").agg(F.min("o_orderpriority").alias("p"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "p"))), lambda x: F.concat(x["y"].cast("string"), F.lit("年是"), x["p"])), "，")
    same = F.when(F.min("p") == F.max("p"), "相同").otherwise("不相同")
    return p.groupBy("o_custkey").agg(F.concat(parts, F.lit("，"), same, F.lit("。")).alias("answer"))


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def sample_head(spark, d):
    """The first rows, which is what this operator is for."""
    return table(spark, d, "documents").orderBy("doc_id").limit(100).select("doc_id", "lang")


@query(f"WITH {CY} SELECT company, COUNT(*) AS n_years, CAST(SUM(CASE WHEN year = 1996 THEN revenue END) AS DOUBLE) AS y1996, MAX(year) AS last_year FROM cy GROUP BY 1")
def year_value_map(spark, d):
    m = cy(spark, d).groupBy("company").agg(F.map_from_entries(F.collect_list(F.struct("year", "revenue"))).alias("m"))
    return m.select("company", F.size("m").cast("long").alias("n_years"), F.try_element_at("m", F.lit(1996)).cast("double").alias("y1996"), F.array_max(F.map_keys("m")).alias("last_year"))


@query(f"WITH {_Q} SELECT id, CASE WHEN regexp_matches(question, '最|前|第') THEN 'query' ELSE 'bug' END AS log FROM q")
def query_log_split(spark, d):
    return questions(spark).select("id", F.when(F.col("question").rlike("最|前|第"), "query").otherwise("bug").alias("log"))


@query(f"WITH {CY} SELECT company, year, CASE WHEN year % 4 = 0 THEN CAST(CAST(n_orders AS BIGINT) AS VARCHAR) || '人' ELSE CAST(CAST(revenue AS DECIMAL(38,2)) AS VARCHAR) || CASE WHEN year % 4 = 1 THEN '元/股' ELSE '元' END END AS value FROM cy")
def value_by_metric_class(spark, d):
    metric = F.when(F.col("year") % 4 == 0, "职工人数").when(F.col("year") % 4 == 1, "每股收益").otherwise("营业收入")
    value = F.when(F.col("year") % 4 == 0, F.col("n_orders").cast("decimal(18,2)")).otherwise(F.col("revenue"))
    return cy(spark, d).select("company", "year", A.format_value(metric, value).alias("value"))


@query(f"WITH {_Q} SELECT id, array_to_string(regexp_extract_all(question, '[一-龥]+'), '|') AS runs FROM q")
def han_runs(spark, d):
    return questions(spark).select("id", F.array_join(F.regexp_extract_all("question", F.lit(r"(\p{IsHan}+)"), F.lit(1)), "|").alias("runs"))


@query("WITH s AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, source FROM documents WHERE contains(lower(text), 'license')), d AS (SELECT DISTINCT source FROM documents) SELECT d.source, CASE WHEN MAX(s.doc_id) IS NULL THEN 'fallback' ELSE 'handler' END AS route, COUNT(s.doc_id) AS n FROM d LEFT JOIN s ON d.source = s.source AND r <= 4 GROUP BY 1")
def retrieval_fallback(spark, d):
    """Sources whose documents answer a topic; the others go to retrieval."""
    docs = table(spark, d, "documents")
    n = F.count_if(F.contains(F.lower("text"), F.lit("license")))
    return docs.groupBy("source").agg(n.alias("n")).select("source", F.when(F.col("n") > 0, "handler").otherwise("fallback").alias("route"), F.least("n", F.lit(4)).cast("long").alias("n"))


@query("SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) / 7, 2) AS DOUBLE) AS two, CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)), 0) AS DOUBLE) AS whole FROM lineitem")
def rounding(spark, d):
    x = F.col("l_extendedprice").cast("decimal(18,2)")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(x.cast("double") / 7, 2).alias("two"), F.round(x, 0).cast("double").alias("whole"))


@query("WITH b AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark) SELECT item_id, array_to_string(w, ' ') AS query, len(list_distinct(w)) AS n_terms FROM b")
def joined_keyword_query(spark, d):
    w = F.split(F.lower("text"), " ")
    return table(spark, d, "benchmark").select("item_id", F.array_join(w, " ").alias("query"), F.size(F.array_distinct(w)).cast("long").alias("n_terms"))


@query("SELECT vec_id, label, ROUND(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_concat([1.0::DOUBLE], list_transform(range(63), lambda i: 0.0::DOUBLE))), 6) AS cosine FROM embeddings")
def cosine_to_axis(spark, d):
    axis = F.array(*[F.lit(1.0 if i == 0 else 0.0) for i in range(64)])
    return table(spark, d, "embeddings").select("vec_id", "label", F.round(R.cosine(F.col("embedding").cast("array<double>"), axis), 6).alias("cosine"))
