"""Burst sessions of a stream of photos, as an extension: the batch rules know no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def burst_sessions(photos: DataFrame, window_s: int = 15, late: str = "10 minutes", by: str | None = None) -> DataFrame:
    """Sessions of photos (key, ts) at most `window_s` whole seconds apart: start, number, first and last time.

    Works on batches and on streams; on a stream a session is final once the watermark has passed it.
    """
    # A session window of w seconds takes in an event exactly w seconds later, as the rule does on whole seconds.
    at = photos.withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp"))).withWatermark("ts", late)
    keys = [F.session_window("ts", f"{window_s} seconds").alias("session"), *([F.col(by)] if by else [])]
    found = at.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return found.select(*([by] if by else []), F.col("session.start").alias("start"), "n", "first", "last", (F.col("n") >= 2).alias("is_burst"))
