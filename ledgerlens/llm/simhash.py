"""SimHash near-duplicates by a generalised pigeonhole search.

Fingerprints are collapsed to distinct values before anything else, so a group of a million copies is one value.
Correlated bits are put into the same partition; each partition i gets its own threshold t_i >= -1 with
sum(t_i + 1) = radius + 1, which by the pigeonhole principle loses no pair: if every partition differed by more than
t_i bits, the whole would differ by more than the radius. Thresholds, and the number of partitions, come from dynamic
programming on candidate counts estimated from all fingerprints: the exact number of pairs that agree on a partition,
carried on to t_i differing bits by the bits' own rates. Few fingerprints give exact 16-bit keys, very many give wider
keys with enumerated neighbours, so the work per fingerprint stays near constant as the input grows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import by_batch, components, materialise, only_rows, release, text_bytes

SEED, WORDS, RADIUS = 42, 3, 3
LAYOUTS = (2, 3, 4)
KEY_COST, PAIR_COST = 1.0, 0.3  # of a key row that is shuffled and sorted, and of a candidate that is compared


def simhash(text: bytes, n: int = WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint of a text's word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < n:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: len(words) - n].tolist()]
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[i:j], seed) for i, j in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)]
    return fold(np.array(hashes, np.uint64))


def fold(hashes: np.ndarray) -> int:
    """The fingerprint of these hashes: bits that more than half of them have; zero of none."""
    total = np.zeros(64, np.int64)
    values = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(values), 1 << 16):
        total += np.unpackbits(values[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS) -> DataFrame:
    """key and ``fp`` (the fingerprint as a signed long) of each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([simhash(t, n) for t in text_bytes(batch.column(1))], np.uint64)
        return pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], names=[key, "fp"])

    return by_batch(docs.select(key, text), run, f"`{key}` {dict(docs.dtypes)[key]}, fp long")


def bit_moments(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """(count, 64x64 counts of bits set together) over all fingerprints; each task sends at most 64 * 65 / 2 numbers."""

    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            bits = np.unpackbits(b.column(0).to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        if n:
            i, j = np.triu_indices(64)
            yield pa.record_batch([pa.array([*(i * 64 + j).tolist(), -1], pa.int32()), pa.array([*total[i, j].astype(np.int64).tolist(), n], pa.int64())], names=["cell", "n"])

    rows = distinct.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    got = {r["cell"]: r["n"] for r in rows}
    both = np.zeros((64, 64))
    for cell, n in got.items():
        if cell >= 0:
            both[cell // 64, cell % 64] = both[cell % 64, cell // 64] = n
    return got.get(-1, 0), both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of about 64 / parts bits, each grown from its most correlated free bit by the bit that correlates most with it."""
    rate = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(rate, rate)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, out = set(range(64)), []
    for k in range(parts):
        width = 64 // parts + (k < 64 % parts)
        seed = max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))
        own = [seed]
        free.discard(seed)
        while len(own) < width:
            best = max(free, key=lambda b: (corr[b, own].sum(), -b))
            own.append(best)
            free.discard(best)
        out.append(sorted(own))
    return out


def mask_of(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def allocate(costs: list[dict[int, float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost with sum(t + 1) = radius + 1, by dynamic programming over partitions and budget."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, ts) in best.items():
            for t, c in own.items():
                s = spent + t + 1
                if s <= radius + 1 and (s not in step or cost + c < step[s][0]):
                    step[s] = (cost + c, [*ts, t])
        best = step
    return best[radius + 1]


def agreeing_pairs(distinct: DataFrame, masks: list[int]) -> list[int]:
    """Pairs of fingerprints that agree on each mask, counted exactly over all of them."""
    keys = distinct.select(F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)])).alias("k"))
    n = keys.groupBy("k.part", "k.v").agg(F.count("*").alias("c")).groupBy("part").agg(F.sum(F.expr("cast(c as double) * (c - 1) / 2")).alias("pairs"))
    got = {r["part"]: r["pairs"] for r in n.collect()}
    return [got.get(i, 0) for i in range(len(masks))]


def plan(distinct: DataFrame, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe."""
    n, both = bit_moments(distinct)
    rate = np.diag(both) / max(n, 1)
    differ = 2 * rate * (1 - rate)
    layouts = [group_bits(n, both, m) for m in LAYOUTS]
    pairs = iter(agreeing_pairs(distinct, [mask_of(g) for layout in layouts for g in layout]))
    found = []
    for layout in layouts:
        costs = []
        for bits in layout:
            agree, odds = next(pairs), differ[bits] / (1 - differ[bits])
            e = [1.0] + [0.0] * radius  # elementary symmetric sums: pairs that differ in k bits per agreeing pair
            for o in odds:
                for k in range(radius, 0, -1):
                    e[k] += e[k - 1] * o
            own = {-1: 0.0}
            for t in range(radius + 1):
                keys = n * (1 + sum(comb(len(bits), k) for k in range(t + 1)))
                own[t] = KEY_COST * keys + PAIR_COST * agree * sum(e[: t + 1])
            costs.append(own)
        cost, ts = allocate(costs, radius)
        found.append((cost, [(b, t) for b, t in zip(layout, ts, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


def link_pairs(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs (a < b) of distinct fingerprints at ``radius`` or fewer differing bits. Candidates are verified in the join itself."""
    index, probe = [], []
    for i, (bits, t) in enumerate(plan(distinct, radius)):
        own = F.col("fp").bitwiseAND(F.lit(mask_of(bits)))
        index.append(F.struct(F.lit(i).alias("part"), own.alias("v")))
        flips = [mask_of(list(c)) for k in range(t + 1) for c in combinations(bits, k)]
        probe += [F.struct(F.lit(i).alias("part"), own.bitwiseXOR(F.lit(m)).alias("v")) for m in flips]
    x = distinct.select(F.col("fp").alias("a"), F.explode(F.array(*probe)).alias("k")).select("a", "k.part", "k.v")
    y = distinct.select(F.col("fp").alias("b"), F.explode(F.array(*index)).alias("k")).select("b", "k.part", "k.v")
    near = (x["part"] == y["part"]) & (x["v"] == y["v"]) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return x.join(y, near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Fingerprint and component of each document; components are connected by links of at most ``radius`` differing bits.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows come out as often as they
    occur. A null key has no part in the smallest key of a component unless all are null. Columns other than the two
    named are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    fps, _ = materialise(fingerprints(docs, key, text), "simhash")
    distinct, path = materialise(fps.groupBy("fp").agg(F.min(key).alias("low")), "simhash-distinct")
    edges = link_pairs(distinct.select("fp"), radius)
    nodes, paths = components(edges)
    roots = distinct.join(nodes, distinct["fp"] == nodes["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    roots, roots_path = materialise(roots, "simhash-roots")
    release(spark, path, *paths)
    lows = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    named = roots.join(lows, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """(_row, _doc) of each row, written: a number and all columns in a struct, so that no name of theirs can clash."""
    return materialise(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")), "rows")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that with the smallest key, with all its columns.

    Null and empty texts have fingerprint zero and are linked like any other. A null key comes after all others; of rows
    with the same key in a component any one stays, and rows of different components stay whatever their keys. Columns
    may have any names; an empty table gives no rows.
    """
    rows, _ = numbered(docs)
    fps, fps_path = materialise(fingerprints(rows.select("_row", F.col("_doc").getField(text).alias("_text")), "_row", "_text"), "simhash")
    distinct, path = materialise(fps.select("fp").distinct(), "simhash-distinct")
    nodes, paths = components(link_pairs(distinct))
    kept = first_rows(rows, fps.withColumnRenamed("fp", "node"), nodes, key)
    release(docs.sparkSession, fps_path, path, *paths)
    return kept


def first_rows(rows: DataFrame, of: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """rows: as ``numbered`` gives them; of: ``_row`` and the node it stands at; nodes: node and root of the nodes with an edge."""
    keys = rows.select("_row", F.col("_doc").getField(key).alias("_key"))
    placed = of.join(nodes, "node", "left").select("_row", F.coalesce("root", "node").alias("root")).join(keys, "_row")
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("_key").isNull().alias("no_key"), "_key", "_row")).alias("f")).select(F.col("f._row").alias("_row"))
    first, _ = materialise(first, "first")
    return only_rows(rows, first)[0].select("_doc.*")
