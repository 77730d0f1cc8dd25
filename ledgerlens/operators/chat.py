"""Chat turns and token arrays of training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs(turns: DataFrame) -> DataFrame:
    """(user, assistant) neighbours of each conversation, in order."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = turns.withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    return x.where((F.col("role") == "user") & (F.col("next_role") == "assistant")).select("conv_id", "turn", F.col("text").alias("question"), "answer")


def transcript(turns: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    label = lambda r: F.when(r == "user", "用户：").when(r == "assistant", "助手：").otherwise("系统：")
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda t: F.concat(label(t["role"]), t["text"])), "\n").alias("transcript"))


def fit_length(ids: Column, n: int, pad: int) -> Column:
    """Cut or padded to n."""
    return F.concat(F.slice(ids, 1, n), F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(ids), F.lit(0))))


def training_row(source: Column, target: Column, most_source: int, most_target: int, end: int, pad: int, ignore: int = -100) -> tuple[Column, Column]:
    """(input ids, labels): source, target, end, padded to the same length; labels ignore source and padding."""
    s, t = F.slice(source, 1, most_source), F.concat(F.slice(target, 1, most_target), F.array(F.lit(end)))
    n = most_source + most_target + 1
    ids = fit_length(F.concat(s, t), n, pad)
    labels = fit_length(F.concat(F.array_repeat(F.lit(ignore), F.size(s)), t), n, ignore)
    return ids, labels
