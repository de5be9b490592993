"""Structured Streaming forms of the rolling statistics, over event time.

An extension: the batch operators count rows, a stream has only time. Means and volumes per key and sliding window are
updated as events arrive; late events are taken until the watermark passes their window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolling_means(events: DataFrame, size: str = "2 hours", slide: str = "30 minutes", late: str = "1 hour", key: str = "event_type") -> DataFrame:
    """window_start, window_end, key, n, mean, sd of ``value`` by sliding window of ``ts``; works on batches as well."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.where("value is not null").groupBy(F.window("ts", size, slide), key)
    w = g.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))
    return w.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key, "n", "mean", "sd")
