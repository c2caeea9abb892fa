"""Edges from event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_activity(events: DataFrame, width: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """(start, src, dst, weight): how often a user had each kind of event in each window; late events count until the watermark.

    ``events``: a streaming or static table of ts, user_id and event_type. State
    is one counter for each user, kind and open window.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    by = timed.groupBy(F.window("ts", width).alias("w"), F.col("user_id").alias("src"), F.col("event_type").alias("dst"))
    return by.agg(F.count("*").alias("weight")).select(F.col("w.start").alias("start"), "src", "dst", "weight")
