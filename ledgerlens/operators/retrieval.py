"""Lexical and vector retrieval.

BM25 reads the corpus once for term and length counts of the queried terms only: a term's frequency in a document is
counted where the text is read, so postings of other terms are never shuffled. Top-k per query is two-level: best k of a
document bucket, then of a query.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.5, 0.75


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a run of Han characters, which has no spaces, gives its overlapping pairs."""
    parted = F.regexp_replace(text, r"(?<=\p{IsHan})(?=[\p{L}\p{N}&&[^\p{IsHan}]])|(?<=[\p{L}\p{N}&&[^\p{IsHan}]])(?=\p{IsHan})", " ")
    han = text.rlike(r"\p{IsHan}")
    words = F.filter(F.split(F.lower(F.when(han, parted).otherwise(text)), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    pairs = lambda t: F.when(t.rlike(r"^\p{IsHan}{2}"), F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(2)))).otherwise(F.array(t))
    return F.when(han, F.flatten(F.transform(words, pairs))).otherwise(words)


def terms(spark, text: str) -> list[str]:
    """A question's terms, cut as documents are, each once."""
    return sorted(set(spark.range(1).select(tokens(F.lit(text)).alias("t")).first()["t"]))


def top_k(scored: DataFrame, by: str, order: list[Column], k: int, key: str) -> DataFrame:
    """rank 1..k per ``by``; buckets first, so that no task sorts all rows of a query."""
    bucket = F.pmod(F.xxhash64(key), F.lit(64))
    first = scored.withColumn("_b", bucket).withColumn("_r", F.row_number().over(Window.partitionBy(by, "_b").orderBy(*order))).where(F.col("_r") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k).drop("_b", "_r")


def bm25(docs: DataFrame, queries: list[tuple[int, list[str]]], k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """qid, key, score, rank. Queries are term lists given by the caller, so the side that is broadcast is theirs."""
    spark = docs.sparkSession
    asked = sorted({t for _, q in queries for t in q})
    words = tokens(F.col(text))
    counted = docs.select(key, words.alias("w")).select(key, F.size("w").alias("dl"), F.filter("w", lambda t: t.isin(*asked)).alias("hit"))
    # a term's frequency is counted where its text is read, so nothing is shuffled for it
    counted = counted.select(key, "dl", F.transform(F.array_distinct("hit"), lambda t: F.struct(t.alias("term"), F.size(F.filter("hit", lambda x: x == t)).alias("tf"))).alias("tf"))
    # one pass for all figures of the corpus: a row without a term for each document, and one for each term it holds
    every = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("tf")))
    marks = counted.select("dl", F.explode(F.concat(every, F.coalesce("tf", F.array().cast("array<struct<term:string,tf:int>>")))).alias("m"))
    told = {r["term"]: r for r in marks.groupBy("m.term").agg(F.count("*").alias("n"), F.sum("dl").alias("dl"), F.count("dl").alias("k")).collect()}  # at most the terms asked for
    whole = told.pop(None, None)
    n, avg = (whole["n"], (whole["dl"] or 0) / (whole["k"] or 1)) if whole else (0, 1)
    rows = [(i, t, math.log(1 + (n - told[t]["n"] + 0.5) / (told[t]["n"] + 0.5))) for i, q in queries for t in q if t in told]
    idf = F.broadcast(spark.createDataFrame(rows, "qid int, term string, idf double"))
    tf = counted.select(key, "dl", F.explode("tf").alias("m")).select(key, "dl", "m.term", "m.tf")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(avg or 1))))
    scored = tf.join(idf, "term").groupBy("qid", key).agg(F.sum(F.round(part, 9).cast("decimal(20,9)")).cast("double").alias("score"))
    return top_k(scored, "qid", [F.desc("score"), F.col(key)], k, key)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, asked: DataFrame, k: int, metric: str = "l2", key: str = "vec_id", block: int = 4096) -> DataFrame:
    """For each query vector (qid, q) its k nearest rows by ``l2`` or ``cosine`` (as minus the cosine), exact, ties by key.

    The query set goes against all rows in blocks of at most ``block`` vectors: each block is one broadcast of bounded
    size and one pass, in which a task keeps its k best rows per query; a window merges the tasks' lists.
    """
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("k"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    # BLAS finds all candidates whose rounded distance can be among the k least; distances are then worked out from differences
    slack = 2e-6

    def against(shared):
        def run(batches):
            qid, q = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                keys, v = b.column(0).to_numpy(), np.stack([np.asarray(x) for x in b.column(1).to_pylist()])
                near = q @ v.T
                if metric == "cosine":
                    near = -near / np.maximum(np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)), 1e-300)
                else:
                    near = (v * v).sum(axis=1)[None] - 2 * near + (q * q).sum(axis=1)[:, None]
                n = min(len(v), k)
                last = np.partition(near, n - 1, axis=1)[:, n - 1 : n]
                if metric == "cosine":
                    most = last + slack
                else:
                    error = 1e-12 * ((v * v).sum(axis=1).max() + (q * q).sum(axis=1)[:, None])
                    most = (np.sqrt(np.maximum(last, 0) + error) + slack) ** 2 + error
                i, j = np.nonzero(near <= most)
                exact = near[i, j] if metric == "cosine" else np.concatenate([np.sqrt(((v[j[s : s + block]] - q[i[s : s + block]]) ** 2).sum(axis=1)) for s in range(0, len(i), block)])
                # of equal distances the k least keys are enough
                order = np.lexsort((keys[j], exact, i))
                i, j, exact = i[order], j[order], exact[order]
                new = np.append(True, (i[1:] != i[:-1]) | (exact[1:] != exact[:-1]))
                at = np.arange(len(i))
                few = at - np.maximum.accumulate(np.where(new, at, 0)) < k
                yield pa.record_batch([pa.array(qid[i[few]]), pa.array(keys[j[few]]), pa.array(exact[few])], names=["qid", key, "d"])

        return run

    found, ids, vecs = None, [], []

    def pass_over():
        shared = spark.sparkContext.broadcast((np.array(ids, np.int64), np.array(vecs, np.float64)))
        out = rows.mapInArrow(against(shared), f"qid long, `{key}` {dict(vectors.dtypes)[key]}, d double")
        return out if found is None else found.union(out)

    for r in asked.select("qid", "q").toLocalIterator():
        ids.append(r["qid"])
        vecs.append(r["q"])
        if len(ids) == block:
            found = pass_over()
            ids, vecs = [], []
    if ids:
        found = pass_over()
    if found is None:
        return spark.createDataFrame([], f"qid long, `{key}` {dict(vectors.dtypes)[key]}, d double, rank int")
    scored = found.withColumn("d", F.round("d", 6))
    return top_k(scored, "qid", [F.col("d"), F.col(key)], k, key)
