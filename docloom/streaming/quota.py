"""Usage per key and UTC day, and failure counts over sliding windows, on event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_usage_stream(calls: DataFrame, key: str, tokens: str, late: str = "1 hour") -> DataFrame:
    """key, day, tokens, calls; days close when the watermark passes them. calls: key, ts, tokens."""
    w = calls.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), key)
    return w.agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("calls")).select(key, F.to_date("w.start").alias("day"), "tokens", "calls")


def failure_windows(failures: DataFrame, keys: list[str], threshold: int, seconds: int = 900, slide: int = 60, late: str = "5 minutes") -> DataFrame:
    """Keys and window starts with `threshold` failures or more."""
    w = failures.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds", f"{slide} seconds").alias("w"), *keys)
    return w.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold).select(*keys, F.col("w.start").alias("start"), "n")
