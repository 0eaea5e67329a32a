"""Event-time windows over a stream or a table, an extension beyond the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import money


def tumbling(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Counts and totals per window and event type; on a stream, state older than the watermark is dropped."""
    if events.isStreaming:
        events = events.withWatermark("ts", lateness)
    grouped = events.groupBy(F.window("ts", width).alias("w"), "event_type")
    rows = grouped.agg(F.count("*").alias("n"), F.sum(money("value")).alias("total"))
    return rows.select(F.col("w.start").alias("window_begin"), "event_type", "n", F.col("total").cast("double").alias("total"))
