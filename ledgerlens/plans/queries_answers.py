"""Queries on rendered answers: ratios with their formulas, ranking answers, topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import answers as A
from ledgerlens.operators import metrics as M
from ledgerlens.operators import retrieval as R
from ledgerlens.plans.queries_metrics import _RATIOS, _sql_ratio, CY, cy, ratio_items
from ledgerlens.registry import query, table


def _ratio_sql() -> str:
    parts = []
    for name, formula in M.RATIOS.items():
        plain = name in M.PLAIN_RATIOS
        value = f"printf('%.2f', ({_sql_ratio(formula)}){'' if plain else ' * 100'}) || '{'' if plain else '%'}'"
        say = f"'根据公式{name}={formula}，得出' || l_suppkey || '在' || year || '年的{name}是' || {value} || '。'"
        none = f"'很抱歉，经查询未找到足够的相关信息，无法提供' || year || '年' || l_suppkey || '的{name}的答案。'"
        parts.append(f"SELECT l_suppkey, year, '{name}' AS ratio, CASE WHEN ({_sql_ratio(formula)}) IS NULL THEN {none} ELSE {say} END AS answer FROM items")
    return f"WITH {_RATIOS} " + " UNION ALL ".join(parts)


@query(_ratio_sql())
def ratio_answers(spark, d):
    """Each ratio of the catalogue told with its formula, or that it cannot be told."""
    x = ratio_items(spark, d)
    stock, year = F.col("l_suppkey").cast("string"), F.concat(F.col("year").cast("string"), F.lit("年"))
    told = []
    for name, formula in M.RATIOS.items():
        value = M.compile_formula(formula)
        plain = name in M.PLAIN_RATIOS
        say = A.fill(A.MATCH_TEMPLATES["ratio" if plain else "percent"], keyword=F.lit(name), formula=F.lit(formula), stock=stock, year=year, res=F.format_string("%.2f", value if plain else value * 100))
        none = A.fill(A.MATCH_TEMPLATES["missing"], year=year, stock=stock, keyword=F.lit(name))
        told.append(F.struct(F.lit(name).alias("ratio"), F.when(value.isNull(), none).otherwise(say).alias("answer")))
    return x.select("l_suppkey", "year", F.explode(F.array(*told)).alias("a")).select("l_suppkey", "year", "a.ratio", "a.answer")


_ASKED = ("年营业收入最高的前3家公司", "年营业收入最高的3家公司", "年营业收入最高的公司", "年营业收入第3高的公司", "年营业收入均位列前3的公司")


@query(f"""WITH {CY}, r AS (SELECT year, company, CAST(revenue AS VARCHAR) AS v, row_number() OVER (PARTITION BY year ORDER BY revenue DESC, company) AS k FROM cy),
 l AS (SELECT year, string_agg('第' || k || '是' || company || '，值为' || v || '元', '，' ORDER BY k) || '。' AS valued, string_agg('第' || k || '是' || company, '，' ORDER BY k) || '。' AS named,
 MAX(CASE WHEN k = 1 THEN company || '，值为' || v || '元' END) AS best, MAX(CASE WHEN k = 3 THEN company || '，值为' || v || '元' END) AS third FROM r WHERE k <= 3 GROUP BY 1)
SELECT year, CAST(b AS INT) AS branch, year || '年在所有的上市公司中,营业收入' || CASE b WHEN 0 THEN '最高的前3家公司如下：' || valued WHEN 1 THEN '最高的3家公司如下：' || valued WHEN 2 THEN '最高的公司是' || best || '。'
 WHEN 3 THEN CASE WHEN third IS NULL THEN '' ELSE '第3高的公司是' || third || '。' END ELSE '均位列前3的公司如下：' || named END AS answer FROM l, range(5) t(b)""")
def statistic_branches(spark, d):
    """The five kinds of ranking answers for each year."""
    best = R.top_k(cy(spark, d), "year", [F.desc("revenue"), F.col("company")], 3, "company")
    rows = F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("company").alias("name"), F.col("revenue").alias("value")))), lambda r: F.struct(r["name"], r["value"]))
    years = best.groupBy("year").agg(rows.alias("rows"))  # three rows a year
    x = years.select("year", "rows", F.posexplode(F.array(*map(F.lit, _ASKED))).alias("branch", "asked"))
    x = x.withColumn("rows", F.when(F.col("branch") == 3, F.slice("rows", 3, 1)).otherwise(F.col("rows")))
    num = F.when(F.col("branch") != 2, F.lit("3"))
    say = A.statistic(F.col("asked"), F.concat(F.col("year").cast("string"), F.lit("年")), F.lit("所有"), F.lit("营业收入"), num, F.col("rows"))
    return x.select("year", "branch", say.alias("answer"))


_PHRASES = [p for t in A.TOPICS for p in t] + ["主营业务"]


@query("SELECT c_custkey, k, CASE " + " ".join(f"WHEN {' OR '.join(f"contains(question, '{p}')" for p in t)} THEN {i}" for i, t in enumerate(A.TOPICS)) + " END AS topic FROM (SELECT c_custkey, k, c_name || '1996年的' || ['" + "', '".join(_PHRASES) + f"'][k + 1] || '如何？' AS question FROM customer, range({len(_PHRASES)}) t(k))")
def topic_routes(spark, d):
    """Topic of each company's questions, null where retrieval answers."""
    x = table(spark, d, "customer").select("c_custkey", "c_name", F.posexplode(F.array(*map(F.lit, _PHRASES))).alias("k", "p"))
    return x.select("c_custkey", F.col("k").cast("long").alias("k"), A.topic(F.concat(F.col("c_name"), F.lit("1996年的"), F.col("p"), F.lit("如何？"))).alias("topic"))
