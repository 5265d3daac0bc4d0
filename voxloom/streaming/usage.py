"""Streaming variants: daily usage against a budget, windowed mode counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_usage(events: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Rows (day, n): searches a UTC day; a day closes when the watermark passes its end."""
    rows = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(F.window("_at", "1 day")).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "n")


def mode_counts(events: DataFrame, mode: str, weight: str, ts: str = "ts", every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Weighted counts per mode and window; late points within the watermark still count."""
    rows = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(F.window("_at", every), mode).agg(F.sum(weight).alias("weight")).select(F.col("window.start").alias("start"), mode, "weight")
