"""Event rates of a running cache: the log's windowed rates as a stream, by event time with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_rates(events: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, n, hit_rate, evict_rate of tumbling windows over a stream of events(ts, event_type); windows close once the watermark passes them."""
    share = lambda kind: F.avg(F.when(F.col("event_type") == kind, 1.0).otherwise(0.0))
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"))
    return windows.agg(F.count(F.lit(1)).alias("n"), share("HIT").alias("hit_rate"), share("EVICT").alias("evict_rate")).select(F.col("w.start").alias("start"), "n", "hit_rate", "evict_rate")
