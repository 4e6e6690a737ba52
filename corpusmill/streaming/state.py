"""Crawl state and duplicate memory as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, key: str, time: str, keep: str = "1 day") -> DataFrame:
    """Rows of a stream whose ``key`` wasn't seen within the watermark ``keep``; state is bounded by it."""
    return stream.withWatermark(time, keep).dropDuplicatesWithinWatermark([key])


def activity(stream: DataFrame, key: str, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows per ``key`` and tumbling window, late rows within ``late`` included."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "n")
