"""Event-time windows of issue activity as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity(events: DataFrame, *, ts: str = "ts", kind: str = "event_type", every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by kind and tumbling window, with a watermark; works on batches and streams alike."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), kind).agg(F.count(F.lit(1)).alias("n_events")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "n_events")


def first_seen(events: DataFrame, key: str, *, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Events without repeats of a key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
