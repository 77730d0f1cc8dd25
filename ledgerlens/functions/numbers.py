"""Numbers in words and amounts with units, as plain functions for questions and as Columns for data."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numerals and units.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
SMALL_UNITS = {"十": 10, "百": 100, "千": 1000}
BIG_UNITS = {"万": 10**4, "亿": 10**8}


def numeral(text: str) -> int | None:
    """A whole number in digits or Chinese numerals (十 is 10, 二十三 is 23, 三百零五万 is 3050000); None if it is neither."""
    if re.fullmatch(r"[0-9]+", text):
        return int(text)
    if not text:
        return None
    total = section = digit = 0
    for c in text:
        if c in DIGITS:
            digit = digit * 10 + DIGITS[c] if digit and c != "零" else DIGITS[c]
        elif c in SMALL_UNITS:
            section += (digit or (1 if c == "十" else 0)) * SMALL_UNITS[c]
            digit = 0
        elif c in BIG_UNITS:
            total = (total + section + digit) * BIG_UNITS[c] if c == "亿" else total + (section + digit) * BIG_UNITS[c]
            section = digit = 0
        else:
            return None
    return total + section + digit


def scale(text: str) -> float | None:
    """An amount such as ``5百万``, ``1.5亿``, ``三千`` or ``1,234.5``."""
    m = re.fullmatch(r"\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*([十百千万亿]*)\s*(?:元|人|家)?\s*", text)
    if m:
        out = float(m[1].replace(",", ""))
        for u in m[2]:
            out *= SMALL_UNITS.get(u) or BIG_UNITS[u]
        return out
    n = numeral(text.strip().rstrip("元人家"))
    return None if n is None else float(n)


def amount(c: Column) -> Column:
    """A column of amounts with thousands commas and units as doubles; null where there is no number."""
    number = F.regexp_replace(F.regexp_extract(c, r"([0-9][0-9,]*\.?[0-9]*)", 1), ",", "").try_cast("double")
    unit = F.regexp_extract(c, r"[0-9]\s*([十百千万亿]+)", 1)
    factor = F.lit(1.0)
    for u, v in (SMALL_UNITS | BIG_UNITS).items():
        factor = factor * F.pow(F.lit(float(v)), F.length(unit) - F.length(F.replace(unit, F.lit(u), F.lit(""))))
    return number * factor


def chinese_small(c: Column) -> Column:
    """Chinese numerals below one hundred, or digits, as int."""
    digit = F.create_map(*[F.lit(x) for k, v in DIGITS.items() for x in (k, v)])
    tens, ones = F.regexp_extract(c, "^(.?)十", 1), F.regexp_extract(c, "十?(.?)$", 1)
    in_words = F.when(c.contains("十"), F.when(tens == "", 10).otherwise(F.try_element_at(digit, tens) * 10) + F.when(ones == "十", 0).when(F.coalesce(ones, F.lit("")) == "", 0).otherwise(F.coalesce(F.try_element_at(digit, ones), F.lit(0)))).otherwise(F.try_element_at(digit, c))
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("int")).otherwise(in_words).cast("int")
