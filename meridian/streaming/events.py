"""Structured Streaming twins of the event operators: sessions and repeats, with late data bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, started, ended, n) of runs of events no more than ``gap`` apart; the same over batches and streams."""
    at = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    at = at.withWatermark("__ts", late) if events.isStreaming else at
    found = at.groupBy(F.col(key), F.session_window("__ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def once(events: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Events without repeats of their keys; a stream forgets keys after ``late``."""
    at = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return at.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else at.dropDuplicates(keys)
