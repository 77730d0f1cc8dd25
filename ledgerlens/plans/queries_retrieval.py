"""Queries on retrieval and entity search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import retrieval as R
from ledgerlens.registry import query, table

ASKED = [(1, ["the", "license", "tion"]), (2, ["und", "der"]), (3, ["que", "los"])]
_TERMS = ", ".join(f"({i}, '{t}')" for i, q in ASKED for t in q)


def _bm25(per_keyword: bool, k: int) -> str:
    qid = "qid * 10 + row_number() OVER (PARTITION BY qid ORDER BY term)" if per_keyword else "qid"
    return f"""WITH w0(qid, term) AS (VALUES {_TERMS}), w AS (SELECT CAST({qid} AS INT) AS qid, term FROM w0),
 d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS t FROM documents),
 s AS (SELECT COUNT(*) AS n, AVG(len(t)) AS avgdl FROM d), x AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d),
 tf AS (SELECT doc_id, dl, term, COUNT(*) AS tf FROM x WHERE term IN (SELECT term FROM w) GROUP BY 1, 2, 3), df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY 1),
 sc AS (SELECT qid, doc_id, CAST(SUM(CAST(ROUND(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (1.5 + 1) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)), 9) AS DECIMAL(20,9))) AS DOUBLE) AS score FROM tf JOIN df USING (term) JOIN w USING (term), s GROUP BY 1, 2),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS rank FROM sc) SELECT qid, doc_id, ROUND(score, 6) AS score, rank FROM r WHERE rank <= {k}"""


@query(_bm25(False, 10))
def bm25_topk(spark, d):
    return R.bm25(table(spark, d, "documents"), ASKED, 10).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(_bm25(True, 4))
def bm25_per_keyword(spark, d):
    each = [(i * 10 + j, [t]) for i, q in ASKED for j, t in enumerate(sorted(q), 1)]
    return R.bm25(table(spark, d, "documents"), each, 4).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


_DIST = "sqrt(list_sum(list_transform(list_zip(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


@query(f"WITH s AS (SELECT q.vec_id AS qid, e.vec_id, ROUND({_DIST}, 6) AS d FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS INT) AS rank FROM s) SELECT * FROM r WHERE rank <= 5")
def dense_l2_topk(spark, d):
    v = table(spark, d, "embeddings")
    return R.nearest(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("q")), 5, "l2")


@query("WITH s AS (SELECT q.vec_id AS qid, e.vec_id, ROUND(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, vec_id) AS rank FROM s) SELECT qid, vec_id, cosine FROM r WHERE rank <= 5 AND cosine > 0.2")
def cosine_top5_threshold(spark, d):
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("q"))
    near = R.nearest(v, asked, 5, "cosine")
    return near.select("qid", "vec_id", (-F.col("d")).alias("cosine")).where("cosine > 0.2")


@query(f"WITH b AS ({_bm25(False, 3)}), s AS (SELECT q.vec_id AS qid, e.vec_id, ROUND({_DIST}, 6) AS d FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS INT) AS rank FROM s) SELECT 'sparse' AS source, CAST(qid AS BIGINT) AS qid, doc_id AS id, rank FROM b UNION ALL SELECT 'dense', qid, vec_id, rank FROM r WHERE rank <= 3")
def hybrid_retrieval(spark, d):
    v = table(spark, d, "embeddings")
    sparse = R.bm25(table(spark, d, "documents"), ASKED, 3).select(F.lit("sparse").alias("source"), F.col("qid").cast("long").alias("qid"), F.col("doc_id").alias("id"), "rank")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("q"))
    dense = R.nearest(v, asked, 3, "l2").select(F.lit("dense").alias("source"), "qid", F.col("vec_id").alias("id"), "rank")
    return sparse.unionByName(dense)


NAMES = ("then", "there", "tion", "hation", "License", "example.com")


@query("WITH n(name) AS (VALUES " + ", ".join(f"('{n}')" for n in NAMES) + "), h AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, name) AS r FROM documents JOIN n ON contains(text, name)) SELECT doc_id, name FROM h WHERE r = 1")
def company_mention_join(spark, d):
    """The longest name that a text holds. The names are a fixed list, so it is one expression and no join."""
    best = F.lit(None).cast("string")
    for n in sorted(NAMES, key=lambda n: (len(n), [-ord(c) for c in n])):
        best = F.when(F.col("text").contains(n), F.lit(n)).otherwise(best)
    return table(spark, d, "documents").select("doc_id", best.alias("name")).where("name is not null")
