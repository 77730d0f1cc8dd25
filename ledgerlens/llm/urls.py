"""URL filter: fixed rules first, then a path-template tree learnt from labelled URLs.

Per host, path segments are generalised lexically (numbers, hashes, dates, file names keep only their shape); then,
level by level, frequent segments with labelled URLs are nodes of their own and all others a wildcard. Siblings are put in
order of their labelled rates, and neighbours that a test of two proportions does not tell apart become one node, which
is the wildcard if that is among them. A template is rejected where its labelled purity, smoothed towards its parent's and
at the top towards the same shape over all hosts, says block.

Everything is aggregates and joins on counts of (host, shape); no step gathers a host's rows, so a host that holds a
third of all URLs only makes a larger count. Counts are written to the shared folder between levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialise, release

#: (host, path prefix, verdict); a rule holds for the host and its subdomains.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DEPTH = 4  # segments that are levels of their own; what follows them is one segment of the last level
MIN_COUNT, MIN_SHARE = 8, 0.01  # below either, a segment is a wildcard's; so a node has at most 100 others
Z = 2.0  # deviations from which two siblings' rates differ
PRIOR = 4.0  # labelled URLs that the parent's purity counts as
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.expr("substring(_url, instr(_url, '://') + 3)")
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.expr("substring(_url, instr(_url, '://') + 3)")
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest fitting rule as host + path, its verdict), null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def shape_of(path: Column) -> Column:
    """The generalised segments of a path, joined by slashes."""

    def one(s: Column) -> Column:
        s = F.translate(s, UPPER, LOWER)
        return (
            F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), F.lit("<date>"))
            .when(s.rlike(r"^[0-9]+$"), F.lit("<num>"))
            .when(s.rlike(r"^[0-9]+\.[a-z]{1,5}$"), F.concat(F.lit("<num>."), F.regexp_extract(s, r"\.([a-z]+)$", 1)))
            .when(s.rlike(r"^[0-9a-f-]{12,}$"), F.lit("<hash>"))
            .when(s.rlike(r"[0-9]{3}"), F.lit("<mixed>"))
            .when(F.length(s) > 40, F.lit("<long>"))
            .when(s.isin("*", "$"), F.lit("<sign>"))  # these name the wildcard and a path's end
            .otherwise(s)
        )

    return F.array_join(F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), one), "/")


def learn(counts: DataFrame) -> tuple[DataFrame, list[str]]:
    """counts: host, shape, n, lab, bad (``lab`` of n are labelled, ``bad`` of these block). Returns host, shape, template, purity and the paths to release."""
    spark = counts.sparkSession
    t = counts.withColumn("node", F.lit("")).withColumn("purity", F.lit(None).cast("double"))
    t, path = materialise(t, "urltree")
    sums = [F.sum(c).alias(c) for c in ("n", "lab", "bad")]
    # the root of each host is smoothed towards the same shape over all hosts, and that towards the rate of all URLs
    top = t.groupBy("shape").agg(F.sum("lab").alias("s_lab"), F.sum("bad").alias("s_bad"))
    bad, lab = t.agg(F.sum("bad"), F.sum("lab")).first()
    rate = ((bad or 0) + 0.5) / ((lab or 0) + 1.0)
    rates = top.select("shape", ((F.col("s_bad") + PRIOR * rate) / (F.col("s_lab") + PRIOR)).alias("shape_rate"))
    hosts = t.groupBy("host").agg(F.sum("lab").alias("h_lab"), F.sum("bad").alias("h_bad"))
    t = t.join(rates, "shape").join(hosts, "host").withColumn("purity", (F.col("h_bad") + PRIOR * F.col("shape_rate")) / (F.col("h_lab") + PRIOR)).drop("shape_rate", "h_lab", "h_bad")
    for depth in range(1, DEPTH + 2):
        seg = F.coalesce(F.get(F.split("shape", "/", DEPTH + 1), F.lit(depth - 1)), F.lit(""))
        t = t.withColumn("seg", seg)
        stat = t.groupBy("host", "node", "seg").agg(*sums)
        parent = stat.groupBy("host", "node").agg(F.sum("n").alias("pn"))
        rare = (F.col("n") < MIN_COUNT) | (F.col("n") < MIN_SHARE * F.col("pn")) | (F.col("lab") == 0)
        sibling = F.when(F.col("seg") == "", "$").when(rare, "*").otherwise(F.col("seg"))
        stat = stat.join(parent, ["host", "node"]).select("host", "node", "seg", "lab", "bad", sibling.alias("sib"))
        pooled = stat.groupBy("host", "node", "sib").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad")).where("sib <> '$' and lab > 0")
        by_rate = Window.partitionBy("host", "node").orderBy(F.col("bad") / F.col("lab"), "sib")  # about 100 rows at most
        lab, bad = F.lag("lab").over(by_rate), F.lag("bad").over(by_rate)
        p = (bad + F.col("bad") + 0.5) / (lab + F.col("lab") + 1.0)
        z = (F.col("bad") / F.col("lab") - bad / lab) / F.sqrt(p * (1 - p) * (1 / lab + 1 / F.col("lab")))
        pooled = pooled.withColumn("apart", F.coalesce((z > Z).cast("int"), F.lit(0)))
        pooled = pooled.withColumn("group", F.sum("apart").over(by_rate.rowsBetween(Window.unboundedPreceding, 0)))
        named = pooled.groupBy("host", "node", "group").agg(F.sort_array(F.collect_list("sib")).alias("sibs"))
        # a slash-free name that no path can hold
        named = named.withColumn("branch", F.when(F.array_contains("sibs", "*"), "*").otherwise(F.array_join("sibs", "#")))
        named = named.select("host", "node", F.explode("sibs").alias("sib"), "branch")
        chosen = stat.join(named, ["host", "node", "sib"], "left").select("host", "node", "seg", F.coalesce("branch", "sib").alias("branch"))
        t = t.join(chosen, ["host", "node", "seg"])
        t = t.withColumn("node", F.when(F.col("branch") == "$", F.col("node")).otherwise(F.concat_ws("/", "node", "branch"))).drop("branch", "seg")
        merged = t.groupBy("host", "node").agg(F.sum("lab").alias("m_lab"), F.sum("bad").alias("m_bad"))
        t = t.join(merged, ["host", "node"]).withColumn("purity", (F.col("m_bad") + PRIOR * F.col("purity")) / (F.col("m_lab") + PRIOR)).drop("m_lab", "m_bad")
        t, step = materialise(t.select("host", "shape", "n", "lab", "bad", "node", "purity"), "urltree")
        release(spark, path)
        path = step
    return t.select("host", "shape", F.col("node").alias("template"), "purity"), [path]


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """Verdict on each URL: that of the longest fitting rule, else block where its template's smoothed purity exceeds a half.

    URLs that a rule decides are the labelled examples of the tree. A null URL or one without ``://`` has an empty host
    and path, and the verdict of that template. Repeated rows and keys are judged alike, each in a row of its own; other
    columns are not read; an empty table gives no rows.
    """
    rows = pages.select(F.col(key).alias(key), F.col(url).alias("_url"))
    rows = rows.select(key, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": said, "shape": shape_of(F.col("path"))})
    counts = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("said").alias("lab"), F.count(F.when(F.col("said") == "block", 1)).alias("bad"))
    tree, _ = learn(counts)
    verdict = F.coalesce("said", F.when(F.col("purity") > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return rows.join(tree, ["host", "shape"]).select(key, "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
