"""Report lines: numbering, header and footer lines, stateful section cuts, tick boxes.

Every state machine is a running-frame window over (document, position): no per-row Python, one shuffle by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUNNING = (Window.unboundedPreceding, Window.currentRow)


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos (from 0), line."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def classify_edges(lines: DataFrame, key: str, header: str, footer: str) -> DataFrame:
    """kind: header for a first line that matches, footer for a last one that does (unless it holds a bracket), else text."""
    w = Window.partitionBy(key)
    first, last = F.min("pos").over(w), F.max("pos").over(w)
    kind = F.when((F.col("pos") == first) & F.col("line").rlike(header), "header").when((F.col("pos") == last) & F.col("line").rlike(footer) & ~F.col("line").contains("["), "footer").otherwise("text")
    return lines.withColumn("kind", kind)


def cut_sections(lines: DataFrame, key: str, start, stop) -> DataFrame:
    """Lines inside a section: after the last start line (itself included) unless a stop line followed; may re-open. A line that is both stays out."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(*RUNNING)
    opened, closed = F.max(F.when(start, F.col("pos"))).over(w), F.max(F.when(stop, F.col("pos"))).over(w)
    marked = lines.withColumns({"_o": opened, "_c": closed})
    return marked.where(F.col("_o").isNotNull() & (F.col("_c").isNull() | (F.col("_o") > F.col("_c")))).drop("_o", "_c")


def cut_first_section(lines: DataFrame, key: str, start, stop, most_chars: int, guard: str, most_guards: int) -> DataFrame:
    """The first section only, ended by a stop line, by ``most_chars`` characters or by ``most_guards`` guard matches before the line."""
    by = Window.partitionBy(key)
    w = by.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    inside = lines.withColumn("_o", F.min(F.when(start, F.col("pos"))).over(by)).where(F.col("pos") >= F.col("_o"))
    chars = F.coalesce(F.sum(F.length("line")).over(w), F.lit(0))
    guards = F.coalesce(F.sum(F.regexp_count("line", F.lit(guard))).over(w), F.lit(0))
    ended = ((F.col("pos") > F.col("_o")) & stop) | (chars >= most_chars) | (guards >= most_guards)
    marked = inside.withColumn("_e", F.when(ended, F.col("pos")))
    end = F.min("_e").over(by)
    return marked.withColumn("_e", end).where(F.col("_e").isNull() | (F.col("pos") < F.col("_e"))).drop("_o", "_e")


def assemble_lines(words: DataFrame, key: str, near: float = 2.0, full: float = 0.85) -> DataFrame:
    """Words (idx, top, x1, text; page_width) to lines: a word joins the line when it is at most ``near`` below the one
    before, or when that one reached ``full`` of the page's width and does not end a sentence. The end is judged by the
    word before, so that the rule stays one window."""
    w = Window.partitionBy(key).orderBy("idx")
    last_top, last_x, last_text = (F.lag(c).over(w) for c in ("top", "x1", "text"))
    joins = (F.abs(F.col("top") - last_top) <= near) | ((last_x >= full * F.col("page_width")) & ~last_text.rlike("[。！？；：0-9元%]$"))
    line = F.sum(F.when(joins, 0).otherwise(1)).over(w.rowsBetween(*RUNNING))
    return words.withColumn("line_no", line).groupBy(key, "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "").alias("line"))


def tick_state(lines: DataFrame, key: str) -> DataFrame:
    """Body lines under the last tick-box line: applies (√) or not (□)."""
    mark = F.when(F.col("line").startswith("√"), F.lit(True)).when(F.col("line").startswith("□"), F.lit(False))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(*RUNNING)
    return lines.withColumn("applies", F.last(mark, ignorenulls=True).over(w)).where(F.col("applies").isNotNull() & mark.isNull())
