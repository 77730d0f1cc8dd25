"""Session builder shared by tests, bench and applications."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "ledgerlens", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session with AQE, UTC and Arrow on. ``master`` is only set for local use; on a cluster spark-submit sets it."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", os.environ.get("LEDGERLENS_DRIVER_MEMORY", "8g"))
    return b.getOrCreate()
