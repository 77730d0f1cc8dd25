"""Questions to QuerySpec: years, places, thresholds, shape and count from a question's text."""

from __future__ import annotations

import re

from ledgerlens.functions.numbers import numeral, scale
from ledgerlens.functions.text import vocabulary_pattern
from ledgerlens.plans.spec import QuerySpec

_NUMBER = r"[0-9][0-9,.]*[十百千万亿]*|[零一二两三四五六七八九十百千万亿]+"
_ABOVE, _BELOW = r"(?:大于|超过|高于|多于)", r"(?:小于|低于|少于|不足)"


def years(question: str) -> tuple[int, ...]:
    """Sorted distinct years; ranges count with all their years, 去年/前年/前两年 relative to the first year named."""
    found = {int(y) for y in re.findall(r"(?<![0-9.])(?:19|20)[0-9]{2}(?![0-9.,百千万亿元])", question)}  # 2000万 is an amount
    for a, b in re.findall(r"((?:19|20)[0-9]{2})年?(?:-|到|至|~)((?:19|20)[0-9]{2})", question):
        found |= set(range(int(a), int(b) + 1))
    if found:
        base = min(found)
        if "前两年" in question:
            found |= {base - 1, base - 2}
        elif "去年" in question or "上年" in question:
            found.add(base - 1)
        elif "前年" in question:
            found.add(base - 2)
    return tuple(sorted(found))


def parse(question: str, companies: list[str], places: list[str], metrics: dict[str, str]) -> QuerySpec:
    """companies and places are vocabularies; metrics maps words to column names. Longest match wins everywhere."""

    def named(words) -> list[str]:
        return list(dict.fromkeys(re.findall(vocabulary_pattern(words), question))) if words else []

    mentioned = named(metrics)
    metric = metrics[mentioned[0]] if mentioned else "revenue"
    ranges = []
    if mentioned:
        low, high = (re.search(rf"{w}({_NUMBER})", question) for w in (_ABOVE, _BELOW))
        if low or high:
            ranges.append((metric, scale(low[1]) if low else None, scale(high[1]) if high else None))
    common = {"metric": metric, "companies": tuple(named(companies)), "years": years(question), "places": tuple(named(places)), "ranges": tuple(ranges)}
    down = not re.search(r"最低|最少|最小|倒数|后[0-9一二三四五六七八九十]+", question)
    if common["companies"]:
        return QuerySpec("point", **common)
    if m := re.search(rf"第({_NUMBER})[高低大小]?", question):
        return QuerySpec("nth", n=numeral(m[1]) or 1, descending="低" not in m[0] and down, **common)
    if m := re.search(rf"(?:前|最[高低大小多少]的?|后)({_NUMBER})(?:家|名|个)?", question):
        shape = "multi_year" if len(common["years"]) > 1 else "topn"
        return QuerySpec(shape, n=numeral(m[1]) or 10, descending=down, **common)
    if re.search(r"最[高大多]", question):
        return QuerySpec("max", **common)
    if re.search(r"最[低小少]", question):
        return QuerySpec("min", descending=False, **common)
    return QuerySpec("count", **common)


def to_sql(s: QuerySpec, view: str = "fin_report") -> str:
    """The same shape as SQL text for stores that take SQL; literals are quoted."""
    quote = lambda x: "'" + str(x).replace("'", "''") + "'"
    where = []
    if s.years:
        where.append(f"year = {s.years[0]}" if len(s.years) == 1 else f"year IN ({', '.join(map(str, s.years))})")
    if s.companies:
        where.append(f"company IN ({', '.join(map(quote, s.companies))})")
    if s.places:
        where.append("(" + " OR ".join(f"place LIKE {quote('%' + p + '%')}" for p in s.places) + ")")
    for m, low, high in s.ranges:
        where += [f"{m} > {low}"] * (low is not None) + [f"{m} < {high}"] * (high is not None)
    if s.shape not in ("count", "point"):
        where.append(f"{s.metric} IS NOT NULL")
    tail = f" WHERE {' AND '.join(where)}" if where else ""
    if s.shape == "count":
        return f"SELECT COUNT(*) AS n FROM {view}{tail}"
    out = f"SELECT company, year, {s.metric} FROM {view}{tail}"
    if s.shape == "point":
        return out
    n = 1 if s.shape in ("nth", "max", "min") else s.n
    down = s.descending and s.shape != "min"
    return f"{out} ORDER BY {s.metric} {'DESC' if down else 'ASC'}, company, year LIMIT {n}" + (f" OFFSET {s.n - 1}" if s.shape == "nth" else "")
