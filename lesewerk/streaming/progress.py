"""Streams of chunk states and level frames. Extras: the batch operators have no event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state_counts(states: DataFrame, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Saved states by window, project and status; rows later than ``late`` are dropped by the watermark."""
    timed = states.withColumn("saved_at", F.col("saved_at").cast("timestamp")).where("saved_at is not null").withWatermark("saved_at", late)
    return timed.groupBy(F.window("saved_at", window).alias("w"), "project_id", "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "project_id", "status", "n")


def sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions by a gap, the event-time form of joining runs that are less than a gap apart."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).where(F.col(time).isNotNull()).withWatermark(time, late)
    return timed.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> None:
    """Works off what is there into a memory table and stops."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
