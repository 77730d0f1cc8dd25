"""Queries on questions, answers, scores and chats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.functions import numbers as N
from ledgerlens.functions import text as X
from ledgerlens.operators import answers as A
from ledgerlens.operators import chat as C
from ledgerlens.operators import evaluation as E
from ledgerlens.plans.nl import parse
from ledgerlens.plans.queries_metrics import CY, cy
from ledgerlens.plans.spec import plan
from ledgerlens.registry import query, table

QUESTIONS = [
    (1, "2019年哪家公司利润总额最高"), (2, "2019-2021年总负债前十家"), (3, "甲公司2020年的研发人数与去年相比"), (4, "2020年到2021年资产总额第三高"),
    (5, "什么是营业收入"), (6, "乙公司前两年(2021年)总人数"), (7, "2021年前年货币资金最低"), (8, "2018至2020年营业收入"),
]
_Q = "q(id, question) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in QUESTIONS) + ")"


def questions(spark):
    return spark.createDataFrame(QUESTIONS, "id int, question string")


@query(f"WITH {_Q} SELECT id, replace(replace(replace(replace(question, '总额', '合计'), '总负债', '负债合计'), '总资产', '资产合计'), '总人数', '总数') AS question FROM q")
def question_normalise(spark, d):
    return questions(spark).select("id", X.normalise(F.col("question")).alias("question"))


@query(f"""WITH {_Q}, a AS (SELECT id, list_transform(regexp_extract_all(question, '(20[0-9]{{2}}|19[0-9]{{2}})'), lambda y: CAST(y AS INT)) AS ys, try_cast(nullif(regexp_extract(question, '((?:19|20)[0-9]{{2}})年?(?:-|到|至|~)((?:19|20)[0-9]{{2}})', 1), '') AS INT) AS lo,
 try_cast(nullif(regexp_extract(question, '((?:19|20)[0-9]{{2}})年?(?:-|到|至|~)((?:19|20)[0-9]{{2}})', 2), '') AS INT) AS hi FROM q),
 b AS (SELECT id, unnest(ys) AS y FROM a UNION SELECT id, unnest(range(lo, hi + 1)) FROM a WHERE lo IS NOT NULL) SELECT id, CAST(y AS INT) AS year FROM b""")
def year_extract_expand(spark, d):
    return questions(spark).select("id", F.explode(X.years_in(F.col("question"))).alias("year"))


@query(f"""WITH {_Q}, b AS (SELECT id, question, CAST(nullif(regexp_extract(question, '20[0-9]{{2}}'), '') AS INT) AS y FROM q),
 e AS (SELECT id, CASE WHEN contains(question, '前两年') THEN [y - 2, y - 1, y] WHEN contains(question, '去年') OR contains(question, '上年') THEN [y - 1, y] WHEN contains(question, '前年') THEN [y - 2, y] ELSE [y] END AS ys FROM b WHERE y IS NOT NULL) SELECT id, CAST(unnest(ys) AS INT) AS year FROM e""")
def relative_years(spark, d):
    base = F.regexp_extract("question", "20[0-9]{2}", 0).try_cast("int")
    return questions(spark).withColumn("y", base).where("y is not null").select("id", F.explode(X.relative_years(F.col("question"), F.col("y"))).alias("year"))


@query(f"WITH {_Q}, y AS (SELECT id, question, unnest(range(CAST(regexp_extract(question, '(20[0-9]{{2}})[年]?[-到至]', 1) AS INT), CAST(regexp_extract(question, '[-到至](20[0-9]{{2}})', 1) AS INT) + 1)) AS year FROM q WHERE regexp_matches(question, '20[0-9]{{2}}年?[-到至]20[0-9]{{2}}')) SELECT id, CAST(year AS INT) AS year, regexp_replace(question, '20[0-9]{{2}}年?[-到至]20[0-9]{{2}}', CAST(year AS VARCHAR)) AS question FROM y")
def multi_year_question_expand(spark, d):
    low, high = F.regexp_extract("question", "(20[0-9]{2})年?[-到至]", 1).try_cast("int"), F.regexp_extract("question", "[-到至](20[0-9]{2})", 1).try_cast("int")
    x = questions(spark).where(F.col("question").rlike("20[0-9]{2}年?[-到至]20[0-9]{2}")).withColumn("year", F.explode(F.sequence(low, high)))
    return x.select("id", "year", F.regexp_replace(F.col("question"), F.lit("20[0-9]{2}年?[-到至]20[0-9]{2}"), F.col("year").cast("string")).alias("question"))


NUMERALS = [("三", 3), ("十", 10), ("十二", 12), ("二十", 20), ("二十五", 25), ("九十九", 99), ("7", 7), ("两", 2), ("四十", 40)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b})" for a, b in NUMERALS) + ") t(numeral, value)")
def zh_numeral(spark, d):
    return spark.createDataFrame([(a,) for a, _ in NUMERALS], "numeral string").select("numeral", N.chinese_small(F.col("numeral")).alias("value"))


UNITS = [("5百万", 5e6), ("1.5亿", 1.5e8), ("3千万", 3e7), ("1,234.5", 1234.5), ("20万元", 2e5), ("800", 800.0), ("2千", 2000.0), ("5百", 500.0)]


@query("SELECT amount, CAST(value AS DOUBLE) AS value FROM (VALUES " + ", ".join(f"('{a}', {b})" for a, b in UNITS) + ") t(amount, value)")
def unit_scale(spark, d):
    return spark.createDataFrame([(a,) for a, _ in UNITS], "amount string").select("amount", N.amount(F.col("amount")).alias("value"))


VOCABULARY = ("the", "then", "tion", "ing", "ation", "of", "heon", "there")


@query("SELECT doc_id, len(regexp_extract_all(text, 'ation|there|heon|then|tion|ing|the|of')) AS n, array_to_string(list_sort(list_distinct(regexp_extract_all(text, 'ation|there|heon|then|tion|ing|the|of'))), ',') AS found FROM documents")
def trie_keywords(spark, d):
    hits = X.keywords(F.col("text"), VOCABULARY)
    return table(spark, d, "documents").select("doc_id", hits.alias("h")).select("doc_id", F.size("h").cast("long").alias("n"), F.array_join(F.array_sort(F.array_distinct("h")), ",").alias("found"))


ALIASES = [("研发人数", "研发人员人数"), ("总负债", "负债合计"), ("利润总额", "利润总额"), ("资产总额", "资产总计"), ("营业收入", "营业收入")]


@query(f"WITH {_Q}, al(word, canonical) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ALIASES) + ") SELECT id, word, canonical FROM q JOIN al ON contains(question, word) WHERE regexp_matches(question, '20[0-9]{2}')")
def keyword_mapping(spark, d):
    canonical = F.create_map(*[F.lit(x) for pair in ALIASES for x in pair])
    q = F.replace(F.col("question"), F.lit("的"), F.lit(""))
    x = questions(spark).where(F.col("question").rlike("20[0-9]{2}")).select("id", F.explode(X.keywords(q, [a for a, _ in ALIASES])).alias("word"))
    return x.select("id", "word", F.element_at(canonical, F.col("word")).alias("canonical"))


@query(f"WITH {_Q}, m(metric) AS (VALUES ('利润总额'), ('总负债'), ('资产总额'), ('货币资金'), ('营业收入')), s AS (SELECT id, metric, length(regexp_extract(question, metric || '(.*?)(最|前|第)', 0)) AS n FROM q, m WHERE regexp_matches(question, metric || '(.*?)(最|前|第)')) SELECT id, arg_min(metric, n) AS metric FROM s GROUP BY 1")
def shortest_span_metric(spark, d):
    metrics = ("利润总额", "总负债", "资产总额", "货币资金", "营业收入")
    spans = F.array(*[F.struct(F.when(F.col("question").rlike(f"{m}(.*?)(最|前|第)"), F.length(F.regexp_extract("question", f"{m}(.*?)(最|前|第)", 0))).alias("n"), F.lit(m).alias("metric")) for m in metrics])
    best = F.array_min(F.filter(spans, lambda s: s["n"].isNotNull()))
    return questions(spark).select("id", best["metric"].alias("metric")).where("metric is not null")


COLUMNS = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
TYPOS = ("order_key", "o_custky", "totalprice", "o_orderdat", "priority")


@query("WITH c(name) AS (VALUES " + ", ".join(f"('{c}')" for c in COLUMNS) + "), t(typo) AS (VALUES " + ", ".join(f"('{t}')" for t in TYPOS) + "), s AS (SELECT typo, name, levenshtein(typo, name) AS d, row_number() OVER (PARTITION BY typo ORDER BY levenshtein(typo, name), name) AS r FROM t, c) SELECT typo, name, CAST(d AS INT) AS d FROM s WHERE r = 1")
def fuzzy_column_repair(spark, d):
    """The nearest column of a schema, which is a fixed list, so the choice is one expression per row."""
    names = spark.read.parquet(f"{d}/orders.parquet").columns
    best = F.array_min(F.array(*[F.struct(F.levenshtein("typo", F.lit(c)).alias("d"), F.lit(c).alias("name")) for c in names if c in COLUMNS]))
    return spark.createDataFrame([(t,) for t in TYPOS], "typo string").select("typo", best["name"].alias("name"), best["d"].alias("d"))


#: Question templates.
GENERATED = (
    "{place}在{city}的公司，{y}年{m}{most}的公司有多少家？",
    "{place}在{city}或{city2}的公司，{y}年{m2}{most}的公司有多少家？",
    "{y}年{short}的{item}是什么？",
    "{short}{y}年的{item}是什么？",
    "{y}年{long}的{item}是什么？",
    "{long}{y}年的{item}是什么？",
    "{y}年{short}的{m}和{m2}分别是什么？",
    "{place}在{city}的公司，{m}{y}年最高的前{n}家公司是？",
    "{place}在{city}或{city2}的公司，{y}年{m}最高的第{n}家公司是？",
)
METRICS = ("营业收入", "利润总额", "货币资金", "总负债")
PLACES, MOST = ("注册", "办公"), ("大于100万", "小于20万", "高于5亿")
_FILL = (  # placeholder, SQL value, Spark value, both from a row of company c and nation n
    ("{place}", "['注册', '办公'][CAST(c_custkey % 2 AS INT) + 1]", lambda: F.element_at(F.array(*map(F.lit, PLACES)), (F.col("c_custkey") % 2 + 1).cast("int"))),
    ("{city}", "n_name", lambda: F.col("n_name")),
    ("{city2}", "r_name", lambda: F.col("r_name")),
    ("{y}", "CAST(2019 + c_custkey % 3 AS VARCHAR)", lambda: (2019 + F.col("c_custkey") % 3).cast("string")),
    ("{m}", "['" + "', '".join(METRICS) + "'][CAST(c_custkey % 4 AS INT) + 1]", lambda: F.element_at(F.array(*map(F.lit, METRICS)), (F.col("c_custkey") % 4 + 1).cast("int"))),
    ("{m2}", "['" + "', '".join(METRICS) + "'][CAST((c_custkey + 1) % 4 AS INT) + 1]", lambda: F.element_at(F.array(*map(F.lit, METRICS)), ((F.col("c_custkey") + 1) % 4 + 1).cast("int"))),
    ("{most}", "['" + "', '".join(MOST) + "'][CAST(c_custkey % 3 AS INT) + 1]", lambda: F.element_at(F.array(*map(F.lit, MOST)), (F.col("c_custkey") % 3 + 1).cast("int"))),
    ("{short}", "substr(c_name, 10)", lambda: F.substr("c_name", F.lit(10))),
    ("{long}", "c_name", lambda: F.col("c_name")),
    ("{item}", "c_mktsegment", lambda: F.col("c_mktsegment")),
    ("{n}", "CAST(c_custkey % 19 + 2 AS VARCHAR)", lambda: (F.col("c_custkey") % 19 + 2).cast("string")),
)
_GENERATED_SQL = "t"
for _p, _v, _ in _FILL:
    _GENERATED_SQL = f"replace({_GENERATED_SQL}, '{_p}', {_v})"


@query("SELECT c_custkey, k, " + _GENERATED_SQL + " AS question FROM (SELECT *, ['" + "', '".join(GENERATED) + "'][k + 1] AS t FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, range(9) b(k))")
def question_generator(spark, d):
    """Nine questions for each company."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    x = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    x = x.select("*", F.posexplode(F.array(*map(F.lit, GENERATED))).alias("k", "t"))
    out = F.col("t")
    for name, _, value in _FILL:
        out = F.replace(out, F.lit(name), value())
    return x.select("c_custkey", F.col("k").cast("long").alias("k"), out.alias("question"))


@query(f"WITH {_Q}, f AS (SELECT *, contains(question, '甲公司') OR contains(question, '乙公司') AS co, contains(question, '甲公司') AS rep, regexp_matches(question, '20[0-9]{{2}}') AS y FROM q) SELECT id, CASE WHEN co AND rep THEN 'report' WHEN co AND y THEN 'missing_report' WHEN y AND regexp_matches(question, '前|最|第|多少家') THEN 'statistic' WHEN y THEN 'year_only' ELSE 'open' END AS class FROM f")
def question_classify(spark, d):
    q = F.col("question")
    return questions(spark).select("id", A.classify(q.rlike("甲公司|乙公司"), q.contains("甲公司"), q, q.rlike("20[0-9]{2}")).alias("class"))


@query(f"WITH {CY} SELECT company, year, company || CAST(year AS VARCHAR) || '年的营业收入是' || CAST(revenue AS VARCHAR) || '元。' AS answer FROM cy WHERE year = 1996")
def answer_template(spark, d):
    x = cy(spark, d).where("year = 1996")
    value = A.format_value(F.lit("营业收入"), F.col("revenue"))
    return x.select("company", "year", A.fill(A.TEMPLATES["metric"], company=F.col("company"), year=F.col("year"), metric=F.lit("营业收入"), value=value).alias("answer"))


@query(f"WITH {CY}, r AS (SELECT year, company, revenue, row_number() OVER (PARTITION BY year ORDER BY revenue DESC, company) AS r FROM cy) SELECT year, CAST(year AS VARCHAR) || '年营业收入' || string_agg('第' || r || '是' || company, '，' ORDER BY r) || '。' AS answer FROM r WHERE r <= 3 GROUP BY year")
def statistic_answer(spark, d):
    w = Window.partitionBy("year").orderBy(F.desc("revenue"), "company")
    top = cy(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 3")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "company"))), lambda x: F.concat(F.lit("第"), x["r"].cast("string"), F.lit("是"), x["company"])), "，")
    return top.groupBy("year").agg(parts.alias("p")).select("year", F.concat(F.col("year").cast("string"), F.lit("年营业收入"), "p", F.lit("。")).alias("answer"))


@query(f"WITH {CY}, p AS (SELECT c_name AS company, MAX(CASE WHEN year = 1996 THEN revenue END) AS v FROM customer LEFT JOIN cy ON c_name = company GROUP BY 1) SELECT company, CASE WHEN v IS NULL THEN '经查询，无法回答' || company || '1996年的问题。' ELSE CAST(v AS VARCHAR) END AS answer FROM p")
def missing_answer(spark, d):
    x = cy(spark, d).where("year = 1996").select("company", "revenue")
    names = table(spark, d, "customer").select(F.col("c_name").alias("company"))
    return names.join(x, "company", "left").select("company", F.coalesce(F.col("revenue").cast("string"), A.fill(A.TEMPLATES["missing"], company=F.col("company"), year=F.lit("1996"))).alias("answer"))


@query(f"WITH {CY} SELECT COUNT(*) AS n FROM cy WHERE year = 1997 AND revenue > 200000.0")
def nl_query(spark, d):
    """A question in words down to its plan."""
    return plan(cy(spark, d), parse("1997年营业收入大于20万的公司有多少家", [], [], {"营业收入": "revenue"}))


@query("SELECT doc_id, quality, toxic, CASE WHEN quality = 0 THEN 0.0 ELSE 0.25 + CASE WHEN toxic = 0 THEN 0.25 ELSE 0.0 END + 0.5 * ((doc_id % 100) / 100.0) END AS score FROM labels")
def answer_score(spark, d):
    sim = (F.col("doc_id") % 100) / F.lit(100.0)
    return table(spark, d, "labels").select("doc_id", "quality", "toxic", E.answer_score(F.col("quality") != 0, F.col("toxic") == 0, sim, F.lit(False)).alias("score"))


@query("WITH g AS (SELECT source, AVG(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS acc, COUNT(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT source, acc, n, ROUND(SUM(acc * n) OVER () / SUM(n) OVER (), 6) AS total FROM g")
def accuracy_weighted(spark, d):
    g = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.avg((F.col("quality") == F.col("toxic")).cast("double")).alias("acc"), F.count("*").alias("n"))
    total = g.agg(F.round(F.sum(F.col("acc") * F.col("n")) / F.sum("n"), 6).alias("total"))
    return g.join(F.broadcast(total))  # one row


@query("SELECT vec_id, label, CAST(list_position(embedding[1:4], list_max(embedding[1:4])) AS INT) - 1 AS choice FROM embeddings")
def argmax_choice(spark, d):
    four = F.slice("embedding", 1, 4)
    return table(spark, d, "embeddings").select("vec_id", "label", (F.array_position(four, F.array_max(four)) - 1).cast("int").alias("choice"))


_PAIRS = "p AS (SELECT conv_id, turn, text AS question, LEAD(text) OVER w AS answer, role, LEAD(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), pr AS (SELECT conv_id, turn, question, answer FROM p WHERE role = 'user' AND nr = 'assistant')"


def pairs(spark, d):
    return C.pairs(table(spark, d, "conversations"))


@query(f"WITH {_PAIRS}, t AS (SELECT conv_id, turn, list_distinct(string_split(question, ' ')) AS a, list_distinct(string_split(answer, ' ')) AS b FROM pr) SELECT conv_id, turn, coalesce(ROUND(2.0 * len(list_intersect(a, b)) / nullif(len(a) + len(b), 0) * 100, 4), 0.0) AS rouge_1 FROM t")
def rouge_n(spark, d):
    return pairs(spark, d).select("conv_id", "turn", E.overlap_f(F.split("question", " "), F.split("answer", " ")).alias("rouge_1"))


@query()
def rouge_l_bleu(spark, d):
    return pairs(spark, d).select("conv_id", "turn", E.rouge_l("question", "answer").alias("rouge_l"), E.bleu("question", "answer").alias("bleu"))


@query(f"WITH {_PAIRS} SELECT * FROM pr")
def chat_history_pairs(spark, d):
    return pairs(spark, d)


@query("SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '用户：' WHEN 'assistant' THEN '助手：' ELSE '系统：' END || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY 1")
def transcript(spark, d):
    return C.transcript(table(spark, d, "conversations"))


@query("WITH s AS (SELECT doc_id, k, substr(text, 1, CAST(length(text) * k // 4 AS BIGINT)) AS t FROM documents, range(1, 5) r(k)) SELECT doc_id, CAST(k AS INT) AS k, substr(t, coalesce(length(LAG(t) OVER (PARTITION BY doc_id ORDER BY k)), 0) + 1) AS delta FROM s")
def token_delta(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"), "text")
    at = lambda k: F.floor(F.length("text") * k / 4).cast("int")
    return x.select("doc_id", "k", F.col("text").substr(at(F.col("k") - 1) + 1, at(F.col("k")) - at(F.col("k") - 1)).alias("delta"))


_IDS = "list_transform(string_split({0}, ' '), lambda w: length(w))"


@query(f"WITH {_PAIRS}, t AS (SELECT conv_id, turn, {_IDS.format('question')}[1:8] AS s, list_append({_IDS.format('answer')}[1:8], 0) AS t FROM pr), u AS (SELECT conv_id, turn, list_concat(s, t) AS ids, list_concat(list_transform(s, lambda x: -100), t) AS lab FROM t) SELECT conv_id, turn, array_to_string(list_concat(ids, list_transform(range(17 - len(ids)), lambda x: -1)), ',') AS input_ids, array_to_string(list_concat(lab, list_transform(range(17 - len(lab)), lambda x: -100)), ',') AS labels FROM u")
def pad_truncate_mask(spark, d):
    ids = lambda c: F.transform(F.split(c, " "), lambda w: F.length(w))
    i, lab = C.training_row(ids("question"), ids("answer"), 8, 8, end=0, pad=-1)
    join = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return pairs(spark, d).select("conv_id", "turn", join(i).alias("input_ids"), join(lab).alias("labels"))


@query("SELECT conv_id, MAX(len(string_split(text, ' '))) AS longest, COUNT(*) AS n FROM conversations GROUP BY 1")
def batch_longest(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max(F.size(F.split("text", " "))).cast("long").alias("longest"), F.count("*").alias("n"))


@query("SELECT conv_id, turn, text FROM conversations WHERE text <> '' AND role <> 'system'")
def drop_incomplete_rows(spark, d):
    return table(spark, d, "conversations").where((F.col("text") != "") & (F.col("role") != "system")).select("conv_id", "turn", "text")


@query("SELECT CASE WHEN regexp_matches(text, 'License') THEN 'licence' WHEN contains(text, '@') THEN 'contact' WHEN contains(text, ' | ') THEN 'table' ELSE 'other' END AS section, COUNT(*) AS n FROM documents GROUP BY 1")
def topical_router(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").groupBy(F.when(t.rlike("License"), "licence").when(t.contains("@"), "contact").when(t.contains(" | "), "table").otherwise("other").alias("section")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, list_sort(list_distinct(list_concat(['doc_id', 'text'], CASE WHEN lang = 'en' THEN ['lang', 'text'] ELSE ['source'] END)))[1] AS first, len(list_distinct(list_concat(['doc_id', 'text'], CASE WHEN lang = 'en' THEN ['lang', 'text'] ELSE ['source'] END))) AS n FROM documents")
def default_columns_union(spark, d):
    more = F.when(F.col("lang") == "en", F.array(F.lit("lang"), F.lit("text"))).otherwise(F.array(F.lit("source")))
    u = F.array_union(F.array(F.lit("doc_id"), F.lit("text")), more)
    return table(spark, d, "documents").select("doc_id", F.array_min(u).alias("first"), F.size(u).cast("long").alias("n"))
