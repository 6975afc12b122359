"""KPIs over streams; the same functions take batch and streaming DataFrames.  (An extension: the data model has no streams.)"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(df: DataFrame, time: str, value: str, keys: list[str], span: str = "1 day", late: str | None = "1 day") -> DataFrame:
    """count and sum for each window and key; rows later than ``late`` are left out of streams (None: a watermark is set already)."""
    rows = df.withWatermark(time, late) if df.isStreaming and late else df
    out = rows.groupBy(F.window(time, span), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str | None = "1 day") -> DataFrame:
    rows = df.withWatermark(time, late) if df.isStreaming and late else df
    out = rows.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def once(df: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Repeated events dropped within the watermark."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
