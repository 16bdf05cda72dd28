"""The event table as a stream: windowed counts with late data, duplicates, sessions, and rolling per-user state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    """Events of a folder of Parquet files, in arrival order of the files; times are UTC."""
    raw = spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("at", F.col("ts").cast("timestamp"))


def distinct_events(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event once; a repeat that arrives within the watermark is dropped, state older than it is forgotten."""
    return stream.withWatermark("at", delay).dropDuplicatesWithinWatermark(["event_id"])


def tumbling_counts(stream: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """(window_start, event_type, events, total_value) per window; rows later than the watermark are left out."""
    grouped = stream.withWatermark("at", delay).groupBy(F.window("at", width), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total_value")).select(
        F.col("window.start").alias("window_start"), "event_type", "events", "total_value"
    )


def user_sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """(user_id, session_start, session_end, events) of sessions that a pause of ``gap`` ends."""
    grouped = stream.withWatermark("at", delay).groupBy(F.session_window("at", gap), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("events")).select(
        "user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events"
    )


def batch_tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """The same windows over a whole table, which the stream must equal once nothing is late."""
    rows = events.filter("ts is not null").withColumn("at", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total_value")).select(
        F.col("window.start").cast(T.TimestampNTZType()).alias("window_start"), "event_type", "events", "total_value"
    )
