"""Streaming form of the monthly aggregates: watermarked event-time windows. The batch plans are the parity surface."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, ts: str, keys: list[str], value: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """window start, keys, n, mean of a stream; a window closes when the watermark has passed it, later rows are dropped."""
    grouped = events.withWatermark(ts, late).groupBy(F.window(ts, window), *keys)
    return grouped.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), *keys, "n", "mean")
