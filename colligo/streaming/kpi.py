"""The same measures over a stream of events: counts and means of time windows, late events dropped after a while."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clustering import band


def windowed(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """``start, end, event_type, n, total, mean, band`` of tumbling or sliding windows, of a stream or a table.

    ``events``: ts, event_type, value.  A window is final once events are ``late`` behind the newest.
    """
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "event_type")
    out = grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
    start = F.col("window.start")
    return out.select(start.alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total", "mean", band(F.hour(start) * 60 + F.minute(start)).alias("band"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """``user_id, start, end, n``: runs of a user's events without a longer gap."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
