"""Question classes and rendered answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = ("report", "missing_report", "statistic", "year_only", "open")
#: Answer templates.
MATCH_TEMPLATES = {
    "money": "{stock}在{year}的{keyword}是{res}元。",
    "formula_money": "根据公式{keyword}={formula}，得出{stock}在{year}的{keyword}是{res}元。",
    "ratio": "根据公式{keyword}={formula}，得出{stock}在{year}的{keyword}是{res}。",
    "percent": "根据公式{keyword}={formula}，得出{stock}在{year}的{keyword}是{res}%。",
    "people": "{stock}在{year}的{keyword}是{res}人。",
    "text": "{stock}在{year}的{keyword}是{res}。",
    "missing": "很抱歉，经查询未找到足够的相关信息，无法提供{year}{stock}的{keyword}的答案。",
}
MISSING_REPORT = "很抱歉，没有找到{company}在{year_time}的年报，无法提供“{query}”问题的答案。"
STATISTIC_TEMPLATES = {
    "top": "{year}在{city}的上市公司中,{keyword}最{direct}的前{num}家公司如下：{res}",
    "some": "{year}在{city}的上市公司中,{keyword}最{direct}的{num}家公司如下：{res}",
    "first": "{year}在{city}的上市公司中,{keyword}最{direct}的公司是{res}。",
    "nth": "{year}在{city}的上市公司中,{keyword}第{num}{direct}的公司是{res}。",
    "always": "{year}在{city}的上市公司中,{keyword}均位列前{num}的公司如下：{res}",
}
#: Topics that have an answer of their own, each with the phrases that lead to it.
TOPICS = (
    ("诚信状况",),
    ("控股股东是否",),
    ("合并报表范围发生变化",),
    ("处罚及整改情况",),
    ("破产重整相关事项",),
    ("聘任、解聘会计师事务所",),
    ("高级管理人员变动情况",),
    ("主要控股参股公司分析",),
    ("重大资产和股权出售",),
    ("控股股东及实控人", "控股股东及实际控制人", "控股股东和实控人", "控股股东和实际控制人"),
)
TEMPLATES = {
    "metric": "{company}{year}年的{metric}是{value}。",
    "missing": "经查询，无法回答{company}{year}年的问题。",
    "nth": "{year}年{metric}第{n}的是{company}。",
}


def topic(question: Column) -> Column:
    """Number of the first topic that the question names, null for none (retrieval answers these)."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(TOPICS))):
        named = question.contains(TOPICS[i][0])
        for phrase in TOPICS[i][1:]:
            named = named | question.contains(phrase)
        out = F.when(named, F.lit(i)).otherwise(out)
    return out


def listed(rows: Column, values: bool) -> Column:
    """Rows (name, value) as 第1是…，值为…元，第2是… with a full stop at the end."""
    told = lambda r: F.concat(r["name"], F.lit("，值为"), r["value"].cast("string"), F.lit("元")) if values else r["name"]
    each = F.transform(rows, lambda r, i: F.concat(F.lit("第"), (i + 1).cast("string"), F.lit("是"), told(r)))
    return F.concat(F.array_join(each, "，"), F.lit("。"))


def statistic(question: Column, year: Column, city: Column, keyword: Column, num: Column, rows: Column) -> Column:
    """The answer to a ranking question from its rows (name, value): 前 lists them (names alone for 均), 最 with a number lists
    them, 第 and 最 alone tell the first row; without rows 没查到. ``num`` is null where the question has no number."""
    direct = F.when(question.contains("低"), "低").otherwise("高")
    first = F.get(rows, F.lit(0))
    one = F.concat(first["name"], F.lit("，值为"), first["value"].cast("string"), F.lit("元"))

    def say(kind: str, res: Column) -> Column:
        return fill(STATISTIC_TEMPLATES[kind], year=year, city=city, keyword=keyword, num=num, direct=direct, res=res)

    return (
        F.when(F.size(rows) == 0, F.lit("没查到"))
        .when(question.contains("前") & question.contains("均"), say("always", listed(rows, False)))
        .when(question.contains("前"), say("top", listed(rows, True)))
        .when(question.contains("最") & num.isNotNull(), say("some", listed(rows, True)))
        .when(question.contains("第"), say("nth", one))
        .otherwise(say("first", one))
    )


def classify(has_company: Column, has_report: Column, question: Column, has_year: Column) -> Column:
    """The five classes, first fitting one wins."""
    ranking = question.rlike("前|最|第|多少家")
    return F.when(has_company & has_report, CLASSES[0]).when(has_company & has_year, CLASSES[1]).when(has_year & ranking, CLASSES[2]).when(has_year, CLASSES[3]).otherwise(CLASSES[4])


def fill(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def format_value(metric: Column, value: Column) -> Column:
    """By kind of metric, first fitting word wins: rates as percent, counts as whole numbers with 人, per-share with 元/股, else 元."""
    cents = value.cast("decimal(38,2)").cast("string")
    return F.when(metric.rlike("率|比例"), F.concat((value * 100).cast("decimal(38,2)").cast("string"), F.lit("%"))).when(metric.rlike("人数|员"), F.concat(value.cast("long").cast("string"), F.lit("人"))).when(metric.contains("每股"), F.concat(cents, F.lit("元/股"))).otherwise(F.concat(cents, F.lit("元")))
