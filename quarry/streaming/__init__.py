"""Windowed aggregates that run alike on batch and streaming frames (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, width: str, by: list[str], late: str | None = None) -> DataFrame:
    """Counts and sums of `value` in fixed windows; `late` sets a watermark on streams."""
    if events.isStreaming and late:
        events = events.withWatermark(ts, late)
    g = events.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    if events.isStreaming and late:
        events = events.withWatermark(ts, late)
    g = events.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")
