"""String functions of questions and report lines."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered replacements that bring metric names to one form.
NORMALISE = (("总额", "合计"), ("总负债", "负债合计"), ("总资产", "资产合计"), ("总人数", "总数"))


def normalise(c: Column, pairs: Iterable[tuple[str, str]] = NORMALISE) -> Column:
    """Ordered replacements; each sees what the one before it made."""
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def vocabulary_pattern(words: Iterable[str]) -> str:
    """An alternation that takes the longest word at the leftmost place; words are literal."""
    return "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", w) for w in sorted(set(words), key=lambda w: (-len(w), w)))


def keywords(c: Column, words: Iterable[str]) -> Column:
    """All leftmost-longest, non-overlapping occurrences of the words, in order."""
    return F.regexp_extract_all(c, F.lit(vocabulary_pattern(words)), F.lit(0))


def fold_width(c: Column) -> Column:
    """Full-width brackets, colons, commas and spaces as half-width."""
    return F.translate(c, "（）：，　", "():, ")


#: Ordinals and marks that a statement row's label may begin with.
LABEL_MARKS = r"([一二三四五六七八九十]+、|\([一二三四五六七八九十]+\)|[0-9]+[.、]|加:|减:|其中:)+"


def strip_label(c: Column, marks: str = LABEL_MARKS, space: str = r"\s", folded: bool = True) -> Column:
    """A statement row's label without spaces, leading ordinals and marks, and without what stands in brackets at its end."""
    c = F.regexp_replace(fold_width(c) if folded else c, space, "")
    return F.split(F.regexp_replace(c, f"^{marks}", ""), r"\(")[0]


def guard_sentinel(sql: str) -> str:
    """Adds ``AND c != 1.0`` to each ``c IS NOT NULL``."""
    return re.sub(r"(\w+)\s+IS NOT NULL", r"\g<0> AND \1 != 1.0", sql)


def like_place(sql: str, column: str = "注册地址") -> str:
    """Equality on a place column as a LIKE, and only the first statement."""
    first = re.search(r"SELECT.*?(?:;|\Z)", sql, re.S | re.I)
    return re.sub(rf"{column}\s*=\s*'([^']*)'", rf"{column} LIKE '%\1%'", first[0] if first else sql)


def years_in(c: Column) -> Column:
    """Distinct years of a question, sorted; a range (2019-2021, 2019年到2021年, 至) counts with all its years."""
    single = F.transform(F.regexp_extract_all(c, F.lit(r"(?<![0-9.])(20[0-9]{2}|19[0-9]{2})(?![0-9.,百千万亿元])"), F.lit(1)), lambda y: y.cast("int"))
    pattern = r"((?:19|20)[0-9]{2})年?(?:-|到|至|~)((?:19|20)[0-9]{2})"
    low, high = (F.regexp_extract(c, pattern, i).try_cast("int") for i in (1, 2))
    span = F.when(low.isNotNull() & (low <= high), F.sequence(F.coalesce(low, F.lit(0)), F.greatest(F.coalesce(high, F.lit(0)), F.coalesce(low, F.lit(0))))).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_union(single, span))


def relative_years(c: Column, base: Column) -> Column:
    """Years that 去年, 上年, 前年 or 前两年 add to a base year; null without a base."""
    return F.when(c.contains("前两年"), F.array(base - 2, base - 1, base)).when(c.contains("去年") | c.contains("上年"), F.array(base - 1, base)).when(c.contains("前年"), F.array(base - 2, base)).otherwise(F.array(base))
