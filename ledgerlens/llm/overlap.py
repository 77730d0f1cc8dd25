"""Near copies by SimHash and MinHash of word shingles: both find candidates, the shingle sets themselves decide.

Documents with equal sets are one node. Fingerprints of the sets are linked by the search of ``simhash`` at its radius,
and what they connect is a key of its nodes; bands of MinHash are further keys, for pairs that a fingerprint tells apart.
Nodes that share a key are linked to the key's smallest node, which gives candidate components with few edges. A candidate component is dealt to blocks; within a block, and with some leaders of
the whole component that every block sees, all pairs that share a key are compared by their exact Jaccard similarity,
and a task returns only a spanning forest. What is not yet connected is then compared block against block, but only
where a key holds nodes of different parts; a large part's blocks never meet each other, so a group of near copies of
any size costs a pass over it. Two documents at the similarity ``ALIKE`` share a band with probability 0.9997, more
alike ones more surely, whatever the size of the input; no band or group is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import by_batch, components, materialise, only_rows, release, small, text_bytes
from ledgerlens.llm.simhash import first_rows, fold, link_pairs, numbered

SEED, WORDS, ALIKE = 42, 5, 0.8
BANDS, ROWS = 20, 5
BLOCK = 128
LEADERS = 16  # nodes of a candidate component, about, that all its blocks see
_G = np.random.default_rng(SEED)
_FACTOR = _G.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_SHIFT = _G.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_FOLD = _G.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingles(text: bytes, n: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < n:
        return np.array([h(joined, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - n].tolist()]
    return np.unique(np.array([h(joined[i:j], seed) for i, j in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)], np.uint64))


def band_keys(s: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(s), 1024):
        low = np.minimum(low, ((s[i : i + 1024, None] ^ _SHIFT) * _FACTOR).min(axis=0))
    k = (low.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64)
    return (k ^ (k >> np.uint64(29))).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, alike: float = ALIKE) -> bool:
    small, large = sorted((len(a), len(b)))
    if not large or small < alike * large:
        return small == large
    both = np.sort(np.concatenate((a, b)))
    same = int((both[1:] == both[:-1]).sum())
    return same >= alike * (small + large - same)


def compare(units: DataFrame) -> DataFrame:
    """units: root, i, j, block, node, part, keys, set. (a, b): a spanning forest, beyond that the parts are connected, of the
    similar pairs of each group (root, i, j): of all its pairs, or where i and j differ of those of one block with another."""

    def run(t: pa.Table) -> pa.Table:
        node, block, part = (t.column(c).to_numpy() for c in ("node", "block", "part"))
        keys = np.array(t.column("keys").to_pylist(), np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        top = np.unique(part, return_index=True, return_inverse=True)
        top = top[1][top[2]].tolist()

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        within = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        out = []
        for x in range(len(node)):
            y = np.arange(x + 1, len(node))
            y = y[((block[y] != block[x]) | within) & (part[y] != part[x])]
            for z in y[(keys[y] == keys[x]).any(axis=1)].tolist():
                p, q = find(x), find(z)
                if p != q and similar(sets[x], sets[z]):
                    top[p] = q
                    out.append((node[x], node[z]))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return units.groupBy("root", "i", "j").applyInArrow(run, "a long, b long")


def links(held: DataFrame) -> tuple[DataFrame, list[str]]:
    """held: root (candidate component), blocks (of it), block and at (that a node is of, and is seen in), node, keys, set.
    (a, b): edges that connect what similar pairs connect, and the paths to release."""
    units = held.select("root", F.explode("at").alias("i"), "block", "node", F.col("node").alias("part"), "keys", "set").withColumn("j", F.col("i"))
    first, path = materialise(compare(units), "links")
    parts, paths = components(first)

    # components of more than one block: what is still apart there, first without the sets
    left = held.where("blocks > 1").select("root", "node", "keys").join(parts.select("node", F.col("root").alias("part")), "node", "left")
    left, left_path = materialise(left.withColumn("part", F.coalesce("part", "node")), "apart")
    of = left.groupBy("root", "part").agg(F.count("*").alias("n")).withColumn("own", F.col("n") >= BLOCK / 2)
    few = of.where("not own").groupBy("root").agg(F.sum("n").alias("few"))
    of = of.join(few, "root", "left").select("root", "part", "own", F.ceil(F.when(F.col("own"), F.col("n")).otherwise(F.col("few")) / BLOCK).alias("blocks"))
    # a large part has blocks of its own; small ones share blocks, and none is cut
    of, of_path = materialise(of, "parts")
    block = F.when(F.col("own"), F.xxhash64("part", F.pmod(F.xxhash64("node"), F.col("blocks")))).otherwise(F.xxhash64("root", F.pmod(F.xxhash64("part"), F.col("blocks")), F.lit(0)))
    placed = left.join(small(of), ["root", "part"]).withColumn("block", block)
    placed, placed_path = materialise(placed.select("root", "node", "part", "own", "block", "keys"), "placed")
    where = placed.select("root", "part", "block", F.when(F.col("own"), F.col("part")).alias("whole"), F.explode("keys").alias("key"))
    mixed = where.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    mixed, mixed_path = materialise(mixed, "mixed")
    sides = where.join(small(mixed), "key").select("key", "root", "block", "whole").distinct()
    x, y = (sides.select("key", *([] if s == "y" else ["root"]), F.col("block").alias(s), F.col("whole").alias(f"{s}_whole")) for s in "xy")
    meet = x.join(y, "key").where("x <= y and not (x_whole <=> y_whole and x_whole is not null)").select("root", F.col("x").alias("i"), F.col("y").alias("j")).distinct()
    meet, meet_path = materialise(meet, "meet")
    both = meet.select("i", "j", F.col("i").alias("block")).union(meet.where("i <> j").select("i", "j", F.col("j").alias("block")))
    members = both.join(placed.select("root", "node", "part", "block"), "block").join(held.select("node", "keys", "set"), "node")
    second, second_path = materialise(compare(members.select("root", "i", "j", "block", "node", "part", "keys", "set")), "links")
    joined = parts.select(F.col("node").alias("a"), F.col("root").alias("b")).union(second)
    return joined, [path, left_path, of_path, placed_path, mixed_path, meet_path, second_path, *paths]


def keyed(sets: DataFrame) -> tuple[DataFrame, str]:
    """sets: node, _row, keys, fp. node, _row and keys, written; the last key is the component of the node's fingerprint by links
    of fingerprints at ``simhash.RADIUS`` or fewer differing bits."""
    sets, path = materialise(sets, "sets")
    distinct, distinct_path = materialise(sets.select("fp").distinct(), "simhash-distinct")
    near, near_paths = components(link_pairs(distinct))
    near = near.select(F.col("node").alias("fp"), F.col("root").alias("near"))
    own = F.xxhash64(F.lit("simhash"), F.coalesce("near", "fp"))
    out, out_path = materialise(sets.join(small(near), "fp", "left").select("node", "_row", F.concat("keys", F.array(own)).alias("keys")), "keyed")
    release(sets.sparkSession, path, distinct_path, *near_paths)
    return out, out_path


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component of documents at similarity ``ALIKE`` or more, that with the smallest key. Candidates
    share a SimHash component or a MinHash band.

    Texts without words (null, empty or white space) are equal. A null key comes after all others; of rows with the same
    key in a component any one stays, and rows of different components stay whatever their keys. All columns come out as
    they are, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows, _ = numbered(docs)

    def mark(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in text_bytes(b.column(1))]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        fp = np.array([fold(s) for s in sets], np.uint64).view(np.int64)
        return pa.record_batch([b.column(0), pa.array(node), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())), pa.array(fp)], names=["_row", "node", "keys", "fp"])

    texts = rows.select("_row", F.col("_doc").getField(text).alias("_text"))
    marked, path = materialise(by_batch(texts, mark, "_row long, node long, keys array<long>, fp long"), "bands")
    one, one_path = keyed(marked.groupBy("node").agg(F.min("_row").alias("_row"), F.first("keys").alias("keys"), F.first("fp").alias("fp")))
    listed = one.select("node", F.explode("keys").alias("key"))
    shared = listed.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1")
    candidates, paths = components(listed.join(shared, "key").select(F.col("node").alias("a"), F.col("low").alias("b")))

    large, large_path = materialise(candidates.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "large")
    dealt = candidates.join(small(large), "root", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    lead = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(1)), F.greatest(F.floor(F.col("n") / LEADERS), F.lit(1))) == 0)
    dealt = dealt.withColumn("at", F.when(lead, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block")))

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = pa.array([shingles(t).tobytes() for t in text_bytes(b.column(6))], pa.binary())
        return pa.record_batch([*b.columns[:6], sets], names=["root", "blocks", "block", "at", "node", "keys", "set"])

    dealt, dealt_path = materialise(dealt.join(one, "node"), "dealt")
    picked, picked_path = only_rows(texts, dealt)
    held = dealt.hint("merge").join(picked, "_row").select("root", "blocks", "block", "at", "node", "keys", "_text")
    held, held_path = materialise(by_batch(held, cut, "root long, blocks int, block int, at array<int>, node long, keys array<long>, set binary"), "held")
    edges, used = links(held)
    nodes, more = components(edges)
    kept = first_rows(rows, marked.select("_row", "node"), nodes, key)
    release(spark, path, one_path, large_path, dealt_path, picked_path, held_path, *paths, *used, *more)
    return kept
