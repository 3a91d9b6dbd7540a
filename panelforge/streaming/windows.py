"""Event-time aggregations that run the same on tables and on streams.

On a stream call ``late()`` first: it sets the watermark that bounds state and drops what comes too late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def late(events: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """The events as timestamps with a watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tumbling(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Count and total by event type and window; sliding with a slide."""
    timed = events if events.isStreaming else events.withColumn("ts", F.col("ts").cast("timestamp"))
    found = timed.groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Count and total by user and session: events less than ``gap`` apart."""
    timed = events if events.isStreaming else events.withColumn("ts", F.col("ts").cast("timestamp"))
    found = timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.drop("session_window")
