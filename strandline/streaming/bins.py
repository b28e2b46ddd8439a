"""Incremental bins over event streams, an extension of the hard bin means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """A stream of event files (event_id, ts, user_id, event_type, value)."""
    return spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_means(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and means of each type in time windows; events later than `late` are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.avg("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Sessions of users with their events and total value."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return s.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "value")


def run_to_memory(stream: DataFrame, name: str) -> DataFrame:
    """Drive a stream over all present files and return what it has put out."""
    q = stream.writeStream.outputMode("complete" if stream.isStreaming else "append").format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return stream.sparkSession.table(name)
