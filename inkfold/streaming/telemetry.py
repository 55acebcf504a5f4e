"""Streaming usage roll-up: watermark, de-duplication, hourly windows. An addition, not a counterpart of the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str = "2 hours", window: str = "1 hour") -> DataFrame:
    """window start, provider_id, requests, credits_charged over a stream or a table of telemetry; repeated event ids count once."""
    rows = events.withWatermark("ts", late)
    rows = rows.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else rows.dropDuplicates(["event_id"])
    sums = rows.groupBy(F.window("ts", window).alias("w"), "provider_id").agg(F.count("*").alias("requests"), F.sum("credits_charged").alias("credits_charged"))
    return sums.select(F.col("w.start").alias("hour"), "provider_id", "requests", "credits_charged")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """organization_id, start, stop, requests of activity sessions."""
    rows = events.withWatermark("ts", late)
    found = rows.groupBy(F.session_window("ts", gap).alias("s"), "organization_id").agg(F.count("*").alias("requests"))
    return found.select("organization_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "requests")
