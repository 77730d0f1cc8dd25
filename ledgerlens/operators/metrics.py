"""Company-year facts and what is derived from them: growth, industry means, ranks, ratios.

All are aggregates and window functions over one shuffle key each; nothing depends on the number of metrics times rows.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
SAMPLED = 8  # sampled values of a group for each bucket that ``average_rank`` cuts it into, about


def company_year(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """company, industry, place, year, revenue, n_orders; revenue summed as decimals, so its value does not depend on order.

    Customers of the same name, industry and place are one company.
    """
    by = orders.groupBy("o_custkey", F.year("o_orderdate").cast("int").alias("year")).agg(F.sum(F.col("o_totalprice").cast(MONEY)).alias("revenue"), F.count("*").alias("n_orders"))
    named = by.join(customer.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    named = named.join(nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    of = named.groupBy(F.col("c_name").alias("company"), F.col("c_mktsegment").alias("industry"), F.col("n_name").alias("place"), "year")
    return of.agg(F.sum("revenue").alias("revenue"), F.sum("n_orders").alias("n_orders"))


def prior(value: str, by: str = "company", year: str = "year") -> Column:
    """The value of exactly the year before; null where that year is missing (a lag would take an older one)."""
    return F.sum(value).over(Window.partitionBy(by).orderBy(year).rangeBetween(-1, -1))


def growth(this: Column, last: Column) -> Column:
    """Percent; null where the last value is missing or zero."""
    this, last = this.cast("double"), last.cast("double")
    return F.when(last != 0, (this - last) / last * 100)


def group_mean(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Adds the group's mean; an aggregate and a join, so that few groups do not mean few tasks."""
    return df.join(df.groupBy(*by).agg((F.sum(value).cast("double") / F.count(value)).alias(name)), by, "left")


def average_rank(df: DataFrame, value: str, by: list[str], name: str, buckets: int = 64) -> DataFrame:
    """Adds the descending rank within the groups, ties at their average, truncated; null for null.

    Each group's values are cut at quantiles of a sample that the values' hashes draw, so every evaluation of the plan makes
    the same cuts, and equal values share a bucket whatever the cuts; a row's rank is what the buckets above hold and its
    rank in its own. No task sorts more than a bucket, however few the groups. Null group keys are a group like any other.
    """
    v = F.col(value)
    known = df.where(v.isNotNull())
    share = F.lit(buckets * SAMPLED * 2.0**31) / F.col("_n")
    drawn = _with(known, known.groupBy(*by).agg(F.count("*").alias("_n")), by).where(F.pmod(F.xxhash64(value), F.lit(1 << 31)) < share)
    cuts = drawn.groupBy(*by).agg(F.filter(F.array_sort(F.collect_set(value)), lambda c, i: i % SAMPLED == SAMPLED - 1).alias("_cuts"))
    x = _with(df, cuts, by)
    x = x.withColumn("_bucket", F.when(v.isNull(), -1).otherwise(F.coalesce(F.size(F.filter("_cuts", lambda c: c > v)), F.lit(0)))).drop("_cuts")
    held = x.where(v.isNotNull()).groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    above = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = _with(x, held.select(*by, "_bucket", above.alias("_above")), [*by, "_bucket"])
    ties = F.count("*").over(Window.partitionBy(*by, "_bucket", value))
    own = F.rank().over(Window.partitionBy(*by, "_bucket").orderBy(F.desc(value)))
    return x.withColumn(name, F.when(v.isNotNull(), (F.col("_above") + own + (ties - 1) / 2).cast("int"))).drop("_bucket", "_above")


def _with(df: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """``df`` and what ``facts`` says of its group, if anything; null keys match null keys."""
    facts = facts.withColumnsRenamed({c: f"_of_{c}" for c in by})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])
    return df.join(facts, same, "left").drop(*[f"_of_{c}" for c in by])


#: The ratio catalogue, name -> formula over items of a company's year.
RATIOS = {
    "营业成本率": "营业成本/营业收入",
    "投资收益占营业收入比率": "投资收益/营业收入",
    "管理费用率": "管理费用/营业收入",
    "财务费用率": "财务费用/营业收入",
    "三费比重": "(销售费用+管理费用+财务费用)/营业收入",
    "企业研发经费占费用比例": "研发费用/(销售费用+财务费用+管理费用+研发费用)",
    "企业研发经费与利润比值": "研发费用/净利润",
    "企业研发经费与营业收入比值": "研发费用/营业收入",
    "研发人员占职工人数比例": "研发人员人数/职工总人数",
    "企业硕士及以上人员占职工人数比例": "(硕士员工人数+博士及以上的员工人数)/职工总人数",
    "毛利率": "(营业收入-营业成本)/营业收入",
    "营业利润率": "营业利润/营业收入",
    "流动比率": "流动资产/流动负债",
    "速动比率": "(流动资产-存货)/流动负债",
    "资产负债比率": "总负债/资产总额",
    "现金比率": "货币资金/流动负债",
    "非流动负债比率": "非流动负债/总负债",
    "流动负债比率": "流动负债/总负债",
    "净利润率": "净利润/营业收入",
}
#: Ratios that are told as numbers; all others are told in percent.
PLAIN_RATIOS = ("企业研发经费占费用比例", "企业研发经费与利润比值", "企业研发经费与营业收入比值", "研发人员占职工人数比例", "企业硕士及以上人员占职工人数比例", "流动比率", "速动比率")
#: The items that the catalogue's formulas name, each once.
RATIO_ITEMS = tuple(dict.fromkeys(m for f in RATIOS.values() for m in re.findall(r"[^\W\d]\w*", f)))


def told_ratio(name: str, value: Column) -> Column:
    """A ratio as text with two decimals, in percent where it is told so; null for null."""
    if name in PLAIN_RATIOS:
        return F.format_string("%.2f", value)
    return F.when(value.isNotNull(), F.concat(F.format_string("%.2f", value * 100), F.lit("%")))


_TOKEN = re.compile(r"\s*(?:([^\W\d]\w*)|(\d+(?:\.\d+)?)|\{(\w+)\}|([-+*/()]))")


def compile_formula(formula: str) -> Column:
    """A formula of names, {placeholders}, numbers, + - * / and brackets as a Column; division by zero gives null. Nothing is evaluated as code."""
    at, tokens = 0, []
    formula = formula.rstrip()
    while at < len(formula):
        m = _TOKEN.match(formula, at)
        if not m:
            raise ValueError(f"unexpected {formula[at:]!r}")
        tokens.append(m)
        at = m.end()
    tokens.append(None)
    place = 0

    def sign() -> str | None:
        return tokens[place][4] if tokens[place] else None

    def atom() -> Column:
        nonlocal place
        t = tokens[place]
        if t is None:
            raise ValueError("formula ends early")
        place += 1
        if t[1] or t[3]:
            return F.col(f"`{t[1] or t[3]}`").cast("double")
        if t[2]:
            return F.lit(float(t[2]))
        if t[4] == "-":
            return -atom()
        if t[4] == "(":
            inner = chain()
            if sign() != ")":
                raise ValueError("missing )")
            place += 1
            return inner
        raise ValueError(f"unexpected {t[4]}")

    def term() -> Column:
        nonlocal place
        left = atom()
        while sign() in ("*", "/"):
            op = sign()
            place += 1
            right = atom()
            left = left * right if op == "*" else F.try_divide(left, right)
        return left

    def chain() -> Column:
        nonlocal place
        left = term()
        while sign() in ("+", "-"):
            op = sign()
            place += 1
            right = term()
            left = left + right if op == "+" else left - right
        return left

    out = chain()
    if tokens[place] is not None:
        raise ValueError("formula goes on")
    return out


def items_of(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Per customer and year: gross, net, tax, quantity, n_lines as decimals."""
    price, off, tax = (F.col(c).cast(MONEY) for c in ("l_extendedprice", "l_discount", "l_tax"))
    lines = lineitem.select("l_orderkey", price.alias("gross"), (price * (1 - off)).alias("net"), (price * (1 - off) * tax).alias("tax"), F.col("l_quantity").cast(MONEY).alias("quantity"))
    by_order = lines.groupBy("l_orderkey").agg(*[F.sum(c).alias(c) for c in ("gross", "net", "tax", "quantity")], F.count("*").alias("n_lines"))
    keyed = by_order.join(orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("int").alias("year")), F.col("l_orderkey") == F.col("o_orderkey"))
    return keyed.groupBy("o_custkey", "year").agg(*[F.sum(c).alias(c) for c in ("gross", "net", "tax", "quantity", "n_lines")])
