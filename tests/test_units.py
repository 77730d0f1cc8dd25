"""Golden cases for functions and operators that SQL twins do not cover."""

from __future__ import annotations

import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions import numbers as N
from ledgerlens.functions import text as X
from ledgerlens.operators import evaluation as E
from ledgerlens.operators import lines as L
from ledgerlens.operators import metrics as M
from ledgerlens.operators import tables as T
from ledgerlens.plans.nl import parse, to_sql, years
from ledgerlens.plans.spec import QuerySpec, plan


@pytest.mark.parametrize(("text", "value"), [("十", 10), ("十九", 19), ("二十", 20), ("一百零五", 105), ("三百零五万", 3_050_000), ("两千", 2000), ("12", 12), ("abc", None), ("", None), ("二亿三千万", 230_000_000)])
def test_numeral(text, value):
    assert N.numeral(text) == value


@given(st.integers(1, 99))
def test_numeral_round_trip(n):
    d = "零一二三四五六七八九"
    words = d[n] if n < 10 else (d[n // 10] if n >= 20 else "") + "十" + (d[n % 10] if n % 10 else "")
    assert N.numeral(words) == n


@pytest.mark.parametrize(("text", "value"), [("1000万", 1e7), ("2000万元", 2e7), ("5百", 500), ("百亿", None), ("1,234.5", 1234.5), ("三千万", 3e7)])
def test_scale(text, value):
    if value is not None:
        assert N.scale(text) == value


@pytest.mark.parametrize("q", ["大于1000万小于2000万", "小于2000万大于1000万"])
def test_range_both_orders(q):
    s = parse(f"2020年营业收入{q}的公司有多少家", [], [], {"营业收入": "revenue"})
    assert s.ranges == (("revenue", 1e7, 2e7),) and s.shape == "count" and s.years == (2020,)


@pytest.mark.parametrize(("q", "shape", "n"), [("2019年营业收入第三高的公司", "nth", 3), ("2019年营业收入最高的公司", "max", 1), ("2019年营业收入前十家", "topn", 10), ("2019-2021年营业收入前5名都有谁", "multi_year", 5), ("2019年营业收入最低的公司", "min", 1), ("甲公司2019年营业收入", "point", 1)])
def test_shapes(q, shape, n):
    s = parse(q, ["甲公司"], ["北京"], {"营业收入": "revenue", "营业": "x"})
    assert (s.shape, s.n, s.metric) == (shape, n, "revenue")


@given(st.integers(0, 499), st.integers(0, 2))
def test_generated_questions_parse(i, k):
    from ledgerlens.plans.queries_language import METRICS

    q = ("{y}年{m}最高的公司", "{y}年{m}前{n}家", "{y}年{m}第{n}高的公司")[k].replace("{y}", str(2019 + i % 3)).replace("{m}", METRICS[i % 4]).replace("{n}", str(i % 10 + 1))
    s = parse(q, [], [], {m: m for m in METRICS})
    assert s.shape == ("max", "topn", "nth")[k] and s.years == (2019 + i % 3,) and s.metric == METRICS[i % 4]


def test_years():
    assert years("2019-2021年") == (2019, 2020, 2021)
    assert years("2021年与去年") == (2020, 2021)
    assert years("什么是利润") == ()


def test_to_sql_quotes():
    assert to_sql(QuerySpec("nth", companies=("a'b",), n=3)) == "SELECT company, year, revenue FROM fin_report WHERE company IN ('a''b') AND revenue IS NOT NULL ORDER BY revenue DESC, company, year LIMIT 1 OFFSET 2"
    assert to_sql(QuerySpec("count")) == "SELECT COUNT(*) AS n FROM fin_report"


def test_sql_and_plan_agree(spark):
    report = spark.createDataFrame([("a", "x", 2019, 3.0), ("b", "y", 2019, 5.0), ("c", "x", 2020, None), ("d", "x", 2019, 5.0)], "company string, place string, year int, revenue double")
    report.createOrReplaceTempView("fin_report")
    for s in (QuerySpec("topn", n=2), QuerySpec("nth", n=2), QuerySpec("min"), QuerySpec("count", places=("x",)), QuerySpec("point", companies=("a",)), QuerySpec("max", years=(2019,))):
        assert [tuple(r) for r in plan(report, s).collect()] == [tuple(r) for r in spark.sql(to_sql(s)).collect()]


def test_text_order_switch(spark):
    report = spark.createDataFrame([("a", "", 2019, "997099270.05"), ("b", "", 2019, "9935038258.59")], "company string, place string, year int, revenue string").withColumn("revenue", F.col("revenue").cast("decimal(20,2)"))
    top = lambda t: plan(report, QuerySpec("topn", n=1, text_order=t)).first()["company"]
    assert top(False) == "b" and top(True) == "a"


def test_growth_and_ratio(spark):
    r = spark.range(1).select(M.growth(F.lit(61868406.67), F.lit(83266718.00)).alias("g"), M.growth(F.lit(1.0), F.lit(0.0)).alias("z"), (F.lit(5756152520.65) / F.lit(10440600536.33) * 100).alias("r")).first()
    assert round(r.g, 2) == -25.70 and r.z is None and round(r.r, 2) == 55.13


@pytest.mark.parametrize("bad", ["", "1 +", "(a", "a b", "__import__('os')", "a ** b"])
def test_formula_rejects(spark, bad):
    with pytest.raises(ValueError):
        M.compile_formula(bad)


def test_formula(spark):
    r = spark.createDataFrame([(6.0, 3.0, 0.0)], "a double, b double, z double").select(M.compile_formula("{a}/{b} - -1 * (a + 2)").alias("x"), M.compile_formula("a / z").alias("y")).first()
    assert r.x == 10.0 and r.y is None


def test_scores(spark):
    def score(base, words, sim, is_open):
        return spark.range(1).select(E.answer_score(F.lit(base), F.lit(words), F.lit(sim), F.lit(is_open)).alias("s")).first().s

    assert score(True, True, 0.9915, False) == pytest.approx(0.99575)
    assert score(False, True, 0.9, False) == 0
    assert score(True, False, 0.6488, False) == pytest.approx(0.5744)
    assert score(False, False, 0.7, True) == pytest.approx(0.7)


def test_rouge_bleu():
    assert E.rouge_l_score("a b c d", "a c d") == round(200 * 3 / 7, 4)
    assert E.bleu4("abcdef", "abcdef") == pytest.approx(1.0) and E.bleu4("abc", "") == 0.0 and E.bleu4("abc", "xyz") == 0.0


def test_line_assembly(spark):
    words = spark.createDataFrame([(1, 0, 10.0, 100.0, "甲", 600.0), (1, 1, 10.5, 560.0, "乙", 600.0), (1, 2, 30.0, 90.0, "丙", 600.0), (1, 3, 50.0, 80.0, "丁", 600.0)], "doc int, idx int, top double, x1 double, text string, page_width double")
    assert [r.line for r in L.assemble_lines(words, "doc").orderBy("line_no").collect()] == ["甲乙丙", "丁"]


def test_section_line_that_is_start_and_stop(spark):
    x = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "S", "b", "SE", "c", "S", "d"])], "doc int, pos int, line string")
    got = L.cut_sections(x, "doc", F.col("line").contains("S"), F.col("line").contains("E"))
    assert [r.line for r in got.orderBy("pos").collect()] == ["S", "b", "S", "d"]


def test_row_stitch_and_labels(spark):
    rows = spark.createDataFrame([(1, 0, ["货币", "1"]), (1, 1, [None, "2"]), (1, 2, ["应收", ""])], "doc int, pos int, cells array<string>")
    assert [r.cells for r in T.stitch_rows(rows, "doc").orderBy("anchor").collect()] == [["货币", "12"], ["应收", ""]]
    label = spark.createDataFrame([("一、营业 总收入（元）",), ("减：营业成本",)], "x string").select(X.strip_label(F.col("x")).alias("y"))
    assert [r.y for r in label.collect()] == ["营业总收入", "营业成本"]


def test_sql_rewrites():
    assert X.guard_sentinel("SELECT a FROM t WHERE a IS NOT NULL") == "SELECT a FROM t WHERE a IS NOT NULL AND a != 1.0"
    assert X.like_place("x SELECT a FROM t WHERE 注册地址='北京';y") == "SELECT a FROM t WHERE 注册地址 LIKE '%北京%';"


def test_sources_and_sinks(spark, tmp_path):
    from ledgerlens.sources import readers as R
    from ledgerlens.sources import sinks as S

    p = tmp_path / "2021-01-01__甲股份有限公司__000001__甲__2020年__年度报告.txt"
    p.write_text('{"page": 1, "allrow": 0, "type": "text", "inside": "x"}\nbroken\n', encoding="utf-8")
    x = R.report_lines(spark, str(tmp_path / "*.txt")).collect()
    assert len(x) == 2 and {r.year for r in x} == {2020} and sum(r._corrupt is not None for r in x) == 1
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    rows.limit(0).write.parquet(str(tmp_path / "t"))
    S.insert_if_absent(rows, str(tmp_path / "t"))
    S.insert_if_absent(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    S.answers(spark.createDataFrame([(1, "q", "a,b\nc")], "id int, question string, answer string"), str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).first().answer == "abc"
    assert R.run_sql(spark, "SELECT nope FROM nowhere")[1] and R.run_sql(spark, "SELECT 1 AS x")[0].first().x == 1
    (tmp_path / "n").write_text(" b.pdf\na.pdf \nc.txt\n")
    assert [r.name for r in R.names(spark, str(tmp_path / "n"), ".pdf").collect()] == ["a.pdf", "b.pdf"]


def test_streams(spark, tmp_path):
    from ledgerlens.streaming import ingest as I

    (tmp_path / "in").mkdir()
    (tmp_path / "in/q.json").write_text('{"id": 1, "question": "a"}\n{"id": 2, "question": "b"}\n')
    q = I.answer_stream(I.question_stream(spark, str(tmp_path / "in")), lambda d: d.withColumn("answer", F.upper("question")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert {r.answer for r in spark.read.json(str(tmp_path / "out")).collect()} == {"A", "B"}
    e = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 5), "x"), (datetime.datetime(2024, 1, 1, 7), "x")], "ts timestamp_ntz, event_type string")
    assert [r.n for r in I.event_windows(e).collect()] == [2]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_ties_go_by_key(spark, metric):
    from ledgerlens.operators.retrieval import nearest

    copies = [(1000 - i, [1.0, 2.0, 2.0]) for i in range(400)]
    rows = spark.createDataFrame([*copies, (5000, [9.0, -1.0, 0.0])], "vec_id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(1, [1.0, 2.0, 2.5]), (2, [1.0, 2.0, 2.0])], "qid long, q array<double>")
    got = sorted((r.qid, r["rank"], r.vec_id) for r in nearest(rows, asked, 5, metric).collect())
    assert got == [(q, i + 1, 601 + i) for q in (1, 2) for i in range(5)]


def test_bm25_finds_han_text(spark):
    from ledgerlens.operators import retrieval as R

    docs = spark.createDataFrame([(1, "公司2020年营业收入为100万元，净利润增长。"), (2, "董事会由九名成员组成。Revenue fell"), (3, None), (4, "收"), (5, "利润分配方案")], "doc_id long, text string")
    assert R.terms(spark, "营业收入2020") == ["2020", "业收", "收入", "营业"]
    got = R.bm25(docs, [(1, R.terms(spark, "营业收入")), (2, R.terms(spark, "净利润")), (3, ["revenue"]), (4, ["收"])], 2).collect()
    assert {(r.qid, r.rank): r.doc_id for r in got} == {(1, 1): 1, (2, 1): 1, (2, 2): 5, (3, 1): 2, (4, 1): 4}


def test_insert_if_absent_with_nulls(spark, tmp_path):
    from ledgerlens.sources.sinks import insert_if_absent

    frame, path = spark.createDataFrame([(1, None), (None, "b"), (2, "c"), (2, "c")], "a int, b string"), str(tmp_path / "t")
    frame.limit(0).write.parquet(path)
    for _ in range(3):
        insert_if_absent(frame, path)
    assert spark.read.parquet(path).count() == 3


def test_ratios_of_the_captured_answers():
    from ledgerlens.operators import metrics as M

    assert len(M.RATIOS) == 19 and len(M.RATIO_ITEMS) == 20 and set(M.PLAIN_RATIOS) <= set(M.RATIOS)


def test_average_rank_with_ties_and_nulls(spark):
    from ledgerlens.operators import metrics as M

    rows = [("a", v, i) for i, v in enumerate([5, 3, 3, None, 1, 5, 5, 9, 2, 2, 2, 2])] + [(None, 4, 90), ("b", None, 91)]
    got = {r.i: r.rank for r in M.average_rank(spark.createDataFrame(rows, "g string, v int, i int"), "v", ["g"], "rank", 3).collect()}
    for g, v, i in rows:
        same = [x for h, x, _ in rows if h == g and x is not None]
        if v is not None and g is not None:
            assert got[i] == int(sum(x > v for x in same) + 1 + (same.count(v) - 1) / 2)
        elif v is None:
            assert got[i] is None


def test_industry_rank_by_name_and_null_groups(spark, tmp_path):
    import duckdb

    from ledgerlens.catalogue import ORACLES, QUERIES

    con = duckdb.connect()
    con.sql("CREATE TABLE nation AS SELECT 1 AS n_nationkey, 'X' AS n_name")
    con.sql("CREATE TABLE customer AS SELECT * FROM (VALUES (1, 'A', 'S', 1), (2, 'A', 'S', 1), (3, 'B', 'S', 1), (4, 'C', NULL, 1)) t(c_custkey, c_name, c_mktsegment, c_nationkey)")
    con.sql("CREATE TABLE orders AS SELECT *, DATE '1995-03-01' AS o_orderdate FROM (VALUES (1, 1, 5.0), (2, 2, 6.0), (3, 3, 7.0), (4, 4, 1.0)) t(o_orderkey, o_custkey, o_totalprice)")
    for t in ("nation", "customer", "orders"):
        con.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    ours = QUERIES["industry_rank"](spark, str(tmp_path)).select("company", "industry", "year", "revenue", "industry_rank")
    theirs = con.sql(f"SELECT company, industry, year, revenue, industry_rank FROM ({ORACLES['industry_rank']})").fetchall()
    assert sorted(map(tuple, ours.collect()), key=str) == sorted(theirs, key=str) and len(theirs) == 3


def test_average_rank_of_many_equal_values(spark):
    from ledgerlens.operators import metrics as M

    frame = spark.range(30000).selectExpr("id % 2 AS g", "cast(pow(id % 3000, 2) AS decimal(18,2)) AS v", "id").repartition(7)
    got = {r.id: r.rank for r in M.average_rank(frame, "v", ["g"], "rank").collect()}
    # 1500 values in each group, ten rows each
    assert all(got[i] == (2999 - i % 3000) // 2 * 10 + 5 for i in range(30000))


def test_statement_row_label_as_in_the_sql(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from ledgerlens.catalogue import ORACLES, QUERIES

    rows = ["a | b", "1.2. x(y) | b", "1、p | 2", "（一） q | 3", "其中：r | 4", "12.\tz w | 5", "加:s | 6", "n\u00a0o | 7"]
    pq.write_table(pa.table({"doc_id": [1, 2], "text": ["\n".join(rows), None]}), f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    ours = QUERIES["statement_row_parse"](spark, str(tmp_path)).select("doc_id", "pos", "label", "value")
    theirs = con.sql(f"SELECT doc_id, pos, label, value FROM ({ORACLES['statement_row_parse']})").fetchall()
    assert sorted(map(tuple, ours.collect())) == sorted(theirs) and len(theirs) == len(rows)


def test_statistic_answers_by_hand(spark):
    from pyspark.sql import functions as F

    from ledgerlens.operators import answers as A

    rows = F.array(F.struct(F.lit("甲").alias("name"), F.lit(3).alias("value")), F.struct(F.lit("乙").alias("name"), F.lit(2).alias("value")))
    say = lambda q, num, r=rows: A.statistic(F.lit(q), F.lit("2020年"), F.lit("所有"), F.lit("营业收入"), F.lit(num), r)
    got = spark.range(1).select(say("最低的前2家", "2").alias("a"), say("最高的2家", "2").alias("b"), say("最高的是", None).alias("c"), say("第2高", "2").alias("d"), say("均位列前2", "2").alias("e"), say("最高", None, F.slice(rows, 1, 0)).alias("f")).first()
    assert got.a == "2020年在所有的上市公司中,营业收入最低的前2家公司如下：第1是甲，值为3元，第2是乙，值为2元。"
    assert got.b == "2020年在所有的上市公司中,营业收入最高的2家公司如下：第1是甲，值为3元，第2是乙，值为2元。"
    assert got.c == "2020年在所有的上市公司中,营业收入最高的公司是甲，值为3元。" and got.d == "2020年在所有的上市公司中,营业收入第2高的公司是甲，值为3元。"
    assert got.e == "2020年在所有的上市公司中,营业收入均位列前2的公司如下：第1是甲，第2是乙。" and got.f == "没查到"
