"""Micro-batches of questions and event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.sources.readers import QUESTION


def question_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(QUESTION).option("maxFilesPerTrigger", files_per_batch).json(path)


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Answers all files there are and ends; a rerun goes on where the checkpoint stands."""
    return answer(questions).writeStream.format("json").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def event_windows(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per event type and window; rows later than the watermark are dropped."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return ts.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
