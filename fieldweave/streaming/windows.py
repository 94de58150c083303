"""Counts of a stream by event-time window; late rows beyond the watermark are dropped by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, time: str, key: str, width: str, delay: str) -> DataFrame:
    windowed = events.withWatermark(time, delay) if events.isStreaming else events
    return windowed.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
