"""Structured Streaming: min/max tiles and interval statistics of a live sample stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite


def live_tiles(stream: DataFrame, bucket: str = "10 seconds", late: str = "1 minute", time: str = "ts") -> DataFrame:
    """(window, session_id, channel_id, min_value, max_value, n) of finite samples; the watermark bounds the state and
    drops samples later than ``late``."""
    v = F.when(finite(F.col("value")), F.col("value"))
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, bucket), "session_id", "channel_id")
        .agg(F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.count(v).alias("n"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "session_id", "channel_id", "min_value", "max_value", "n")
    )


def live_rolling(stream: DataFrame, width: str = "1 minute", slide: str = "10 seconds", late: str = "1 minute", time: str = "ts") -> DataFrame:
    """Mean, rms and deviation of each sliding window."""
    v = F.when(finite(F.col("value")), F.col("value"))
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, width, slide), "session_id", "channel_id")
        .agg(F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rms"), F.stddev_pop(v).alias("std"))
        .select(F.col("window.end").alias("end"), "session_id", "channel_id", "mean", "rms", "std")
    )
