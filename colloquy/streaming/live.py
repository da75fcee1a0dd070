"""Event-time rates of tool calls, the same for streams and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.facts import is_error, rate


def hourly_error_rate(calls: DataFrame, every: str = "1 hour", watermark: str | None = "1 day") -> DataFrame:
    """Calls and error rate of each tool and window; with a watermark rows later than that are dropped."""
    rows = calls.withColumn("ts", F.col("ts").cast("timestamp"))  # event time needs an instant
    rows = rows.withWatermark("ts", watermark) if watermark else rows
    by = rows.groupBy(F.window("ts", every).alias("w"), "name").agg(F.count(F.lit(1)).alias("calls"), rate(F.count_if(is_error()), F.count(F.lit(1))).alias("error_rate"))
    return by.select(F.col("w.start").alias("hour"), "name", "calls", "error_rate")


def work_sessions(calls: DataFrame, gap: str = "1 hour", watermark: str | None = "1 day") -> DataFrame:
    """Bursts of each user's calls no further apart than `gap`."""
    rows = calls.withColumn("ts", F.col("ts").cast("timestamp"))  # event time needs an instant
    rows = rows.withWatermark("ts", watermark) if watermark else rows
    by = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("calls"))
    return by.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "calls")
