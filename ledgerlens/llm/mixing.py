"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that a document counts for). A small network routes
tokens from sources' quotas through patterns; the arc of a pattern is split into one layer per pass over its documents,
each dearer than the one before (convex repetition costs), so repetition is spread instead of piled on one pattern.
Successive shortest paths solve it on the driver: its size is the number of patterns, not of documents. What a pattern
takes becomes whole passes for all of its documents and one more for a seeded selection, drawn in order of a hash up to
the quota; that order is found by exact histograms of the hash, level by level, never by sorting a pattern in one task.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialise, small

SEED = 17
WEIGHTS = (3, 1, 2)
SHARE = 1.5  # of all sizes, in total
MOST = 2  # passes over a document
BITS, LEVELS = 12, 2  # of the hash, a histogram; after that the boundary cell is ordered itself


def targets(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess is shared again by weight among the others."""
    out: dict = {}
    free = [s for s in sizes]
    left = total
    while free:
        w = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / w > most * sizes[s]]
        if not over:
            out |= {s: left * weights[s] / w for s in free}
            break
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def flow(patterns: list[tuple[tuple, int]], quotas: dict, most: int = MOST) -> list[float]:
    """Tokens taken from each pattern (sources, size): min-cost flow from quotas to patterns with layered, ever dearer passes.

    Arcs: start -> source (its quota, cost 0), source -> pattern (no bound, 0) for each source of the pattern, pattern ->
    end once per pass p (its size, cost p). All paths of a pass cost the same, so passes are filled in order, each by
    augmenting along shortest residual paths (breadth first), which is successive shortest paths on this network. A source
    whose patterns are all its own has a network of its own; it is filled pass by pass without a search, so only sources
    that overlap others are ever searched.
    """
    shared = {s for p, _ in patterns if len(p) > 1 for s in p}
    of: dict = {s: [] for s in quotas}
    for j, (p, _) in enumerate(patterns):
        for s in p:
            of[s].append(j)
    left = {s: float(q) for s, q in quotas.items()}
    sent: dict[tuple, float] = {}  # (source, pattern)
    carried: dict[int, set] = {j: set() for j in range(len(patterns))}  # sources whose flow a pattern holds
    taken = [0.0] * len(patterns)
    tiny = 1e-9
    for s in quotas:
        if s not in shared:
            for p in range(1, most + 1):
                for j in of[s]:
                    amount = min(left[s], p * patterns[j][1] - taken[j])
                    taken[j] += amount
                    left[s] -= amount
    for p in range(1, most + 1):
        room = [p * n - t for (_, n), t in zip(patterns, taken, strict=True)]
        for s0 in (s for s in quotas if s in shared):
            while left[s0] > tiny:
                # breadth first from a source: to its patterns, and from a pattern back along flow of other sources
                came_p: dict[int, object] = {}
                came_s: dict = {s0: None}
                queue, goal = deque([s0]), None
                while queue and goal is None:
                    s = queue.popleft()
                    for j in of[s]:
                        if j in came_p:
                            continue
                        came_p[j] = s
                        if room[j] > tiny:
                            goal = j
                            break
                        for other in carried[j]:
                            if other not in came_s and sent[other, j] > tiny:
                                came_s[other] = j
                                queue.append(other)
                if goal is None:
                    break
                path, j = [], goal
                while True:
                    s = came_p[j]
                    path.append((s, j))
                    if came_s[s] is None:
                        break
                    j = came_s[s]
                amount = min([left[s0], room[goal]] + [sent[path[k][0], path[k + 1][1]] for k in range(len(path) - 1)])
                for k, (s, j) in enumerate(path):
                    sent[s, j] = sent.get((s, j), 0.0) + amount
                    carried[j].add(s)
                    if k + 1 < len(path):
                        sent[s, path[k + 1][1]] -= amount
                left[s0] -= amount
                room[goal] -= amount
                taken[goal] += amount
    return taken


def words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def select_seeded(docs: DataFrame, need: DataFrame, order: F.Column, patterns: int) -> DataFrame:
    """Adds ``extra`` (boolean): the rows of each pattern in order of ``order`` until their sizes come nearest to ``need``'s tokens.

    docs: pattern, size; need: pattern, tokens. Exact: histograms narrow the boundary to one cell of BITS * LEVELS bits
    per pattern, and only that cell's rows are put in order. Rows without size are never extra.
    """
    marked = docs.withColumn("_u", order)
    state = need.select("pattern", F.col("tokens").alias("_rest"), F.lit(0).cast("long").alias("_cell"))
    for level in range(LEVELS):
        shift = 63 - BITS * (level + 1)
        cell = F.shiftrightunsigned("_u", shift)
        inside = marked.join(small(state, patterns), "pattern") if level else marked.join(small(need.select("pattern"), patterns), "pattern")
        if level:
            inside = inside.where(F.shiftrightunsigned("_u", shift + BITS) == F.col("_cell"))
        sums = inside.select("pattern", cell.alias("c"), "size").groupBy("pattern", "c").agg(F.sum("size").alias("s"))
        before = F.coalesce(F.sum("s").over(Window.partitionBy("pattern").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = sums.join(small(state, patterns), "pattern").withColumn("before", before).where("before <= _rest")
        last = at.groupBy("pattern").agg(F.max(F.struct("c", "before")).alias("m"))
        rows = last.join(small(state, patterns), "pattern").select("pattern", (F.col("_rest") - F.col("m.before")).alias("_rest"), F.col("m.c").alias("_cell")).collect()
        state = _table(docs.sparkSession, [tuple(r) for r in rows], "pattern int, _rest double, _cell long")
    cell = F.shiftrightunsigned("_u", 63 - BITS * LEVELS)
    edge = marked.join(small(state, patterns), "pattern").where(cell == F.col("_cell"))
    run = Window.partitionBy("pattern").orderBy("_u", "size", "_row").rowsBetween(Window.unboundedPreceding, 0)
    # a row at the boundary is taken where that comes nearer to the need than leaving it
    edge = edge.withColumn("_sum", F.sum("size").over(run)).where((F.col("size") > 0) & (F.col("_sum") - F.col("size") / 2.0 <= F.col("_rest"))).select(F.col("_row").alias("_taken"))
    edge, _ = materialise(edge, "edge")
    below = F.col("_cell").isNotNull() & (cell < F.col("_cell")) & (F.col("size") > 0)
    out = marked.join(small(state.select("pattern", "_cell"), patterns), "pattern", "left").join(small(edge, edge.count()), F.col("_row") == F.col("_taken"), "left")
    return out.withColumn("extra", F.coalesce(below, F.lit(False)) | F.col("_taken").isNotNull()).drop("_u", "_cell", "_taken")


def _chosen(docs: DataFrame, keep: list, text: str, source: str, key: str, weights, share: float, most: int, seed: int) -> DataFrame:
    """The columns ``keep`` with size, source_size, target and taken of each row."""
    spark = docs.sparkSession
    many = dict(docs.dtypes)[source].startswith("array")
    own = F.array_sort(F.array_distinct(F.coalesce(source, F.array(F.lit(None).cast("string"))))) if many else F.array(F.col(source).cast("string"))
    rows = docs.select(F.struct(*keep).alias("_doc"), words(F.col(text)).alias("size"), own.alias("sources"), F.monotonically_increasing_id().alias("_row"), F.xxhash64(F.lit(seed), key, F.col(text)).alias("_h"))
    # written once: later steps read sizes instead of texts, and row numbers stay the same
    rows, _ = materialise(rows, "mix")
    name = F.to_json(F.struct(F.col("sources").alias("s")), {"ignoreNullFields": "false"})  # as text, so that a null source finds its pattern
    found = rows.groupBy("sources").agg(F.sum("size").alias("size")).collect()
    patterns = sorted(((tuple(r["sources"]), r["size"]) for r in found), key=lambda x: [(s is None, s or "") for s in x[0]])
    names = sorted({s for p, _ in patterns for s in p}, key=lambda s: (s is None, s or ""))
    sizes = dict.fromkeys(names, 0)
    for p, n in patterns:
        for s in p:
            sizes[s] += n
    goal = targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(names)}, share * sum(n for _, n in patterns), most)
    taken = flow(patterns, goal, most)
    plan = []
    for i, ((p, n), t) in enumerate(zip(patterns, taken, strict=True)):
        passes = int(t // n) if n else 0
        plan.append((i, list(p), float(t - passes * n), passes, sizes[p[0]], float(goal[p[0]])))
    table = _table(spark, plan, "pattern int, sources array<string>, tokens double, passes long, source_size long, target double")
    table = table.withColumn("_name", name).drop("sources")
    part = rows.withColumn("_name", name).drop("sources").join(small(table, len(plan)), "_name").drop("_name")
    chosen = select_seeded(part, table.select("pattern", "tokens"), F.col("_h").bitwiseAND(F.lit((1 << 63) - 1)), len(plan))
    took = (F.col("passes") + F.col("extra").cast("long")) * F.col("size")
    return chosen.select("_doc", "size", "source_size", "target", F.least(took, F.lit(most) * F.col("size")).alias("taken"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """How many words of each document the mix takes: key, size, source_size, target, taken.

    ``source`` is a string, or an array of strings for documents that several sources hold. Sources by code point, null
    last, weigh ``weights`` in turn and share ``share`` of all sizes; no target exceeds ``most`` times its source's size.
    A null text has size 0 and is never taken; an empty table gives no rows; repeated rows are separate documents that
    may be taken differently. Columns other than the three named are not read. A document of several sources reports
    the first one's size and target. Reruns over the same files agree.
    """
    return _chosen(docs, [F.col(key).alias("k")], text, source, key, weights, share, most, seed).select(F.col("_doc.k").alias(key), "size", "source_size", "target", "taken")


def take(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix as rows: each row as often as it is taken, with all its columns, whatever their names.

    Rows with the same or a null key are taken each on its own; what has no words is never taken; an empty table gives no
    rows.
    """
    m = _chosen(docs, [F.col(f"`{c}`") for c in docs.columns], text, source, key, weights, share, most, seed).where("taken > 0")
    return m.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("taken div size"))).alias("_pass")).select("_doc.*")
