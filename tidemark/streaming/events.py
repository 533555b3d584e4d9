"""Windows over event streams (an extension: batch and stream run the same plan)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, *, time: str = "ts", kind: str = "event_type", width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events and their values by window and kind; later rows than the watermark allows are left out in a stream."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    counted = stamped.groupBy(F.window("_t", width).alias("w"), kind).agg(F.count("*").alias("n"), F.max("value").alias("high"))
    return counted.select(F.col("w.start").alias("start"), kind, "n", "high")


def sessions(events: DataFrame, *, time: str = "ts", key: str = "user_id", gap: str = "2 hours", late: str = "2 hours") -> DataFrame:
    """Runs of a key's events with less than `gap` between them."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    found = stamped.groupBy(F.session_window("_t", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
