"""Scores of answers and models."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def answer_score(base_ok: Column, keywords_ok: Column, similarity: Column, is_open: Column) -> Column:
    """0 for a wrong base; else a quarter, a quarter for all keywords, and half the best similarity. Open questions: the similarity."""
    return F.when(is_open, similarity).when(~base_ok, 0.0).otherwise(0.25 + F.when(keywords_ok, 0.25).otherwise(0.0) + 0.5 * similarity)


def ngrams(tokens: Column, n: int) -> Column:
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def overlap_f(a: Column, b: Column) -> Column:
    """F measure of distinct n-gram sets, times 100, to 4 digits."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(F.round(F.try_divide(2 * both, F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))) * 100, 4), F.lit(0.0))


def lcs(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def rouge_l_score(x: str | None, y: str | None) -> float:
    p, q = (x or "").split(), (y or "").split()
    n = lcs(p, q) if p and q else 0
    return round(200.0 * n / (len(p) + len(q)), 4) if n else 0.0


def rouge_l(a: Column | str, b: Column | str) -> Column:
    """A longest common subsequence is beyond built-in functions, so this is one Arrow-batched function."""

    def scores(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([rouge_l_score(p, q) for p, q in zip(x, y, strict=True)])

    return F.pandas_udf(scores, "double")(a, b)


def bleu4(reference: str, candidate: str) -> float:
    """Character BLEU-4 with a geometric sequence for empty n-gram orders (smoothing method 3)."""
    if not candidate or not reference:
        return 0.0
    logs, k = 0.0, 1
    for n in range(1, 5):
        c = Counter(candidate[i : i + n] for i in range(len(candidate) - n + 1))
        r = Counter(reference[i : i + n] for i in range(len(reference) - n + 1))
        hit, total = sum(min(v, r[g]) for g, v in c.items()), max(1, sum(c.values()))
        if hit == 0:
            if n == 1:
                return 0.0
            hit, k = 1 / 2**k, k + 1
        logs += math.log(hit / total) / 4
    short = min(0.0, 1 - len(reference) / len(candidate))
    return math.exp(short + logs)


def bleu(a: Column | str, b: Column | str) -> Column:
    def scores(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([round(bleu4(p or "", q or "") * 100, 4) for p, q in zip(x, y, strict=True)])

    return F.pandas_udf(scores, "double")(a, b)
