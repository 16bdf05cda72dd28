"""Aligning news to the first session that could react to it."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.calendar import session_calendar

#: Seconds before the open at which a session's information window ends.
BUFFER_SECONDS = 300


def day_windows(df: DataFrame, day: Column, buffer_seconds: int = BUFFER_SECONDS, pad: int = 15) -> DataFrame:
    """(calendar_day, session, cutoff, window_start, next_session, next_cutoff, next_window_start) of each day in range.

    For every calendar day of ``df``: the first session on or after it, with
    the end (open less the buffer) and start (previous close) of its
    information window, and the same of the session after that. One row a day.
    """
    first, last = df.agg(F.min(day), F.max(day)).first()
    spark = df.sparkSession
    if first is None:
        first = last = date(2020, 1, 1)
    sessions = session_calendar(spark, first - timedelta(pad), last + timedelta(pad))
    w = Window.orderBy("session")
    cutoff = F.col("open_at") - F.expr(f"interval {buffer_seconds} seconds")
    ordered = sessions.select(
        "session", cutoff.alias("cutoff"), F.lag("close_at").over(w).alias("window_start"), F.lag("session").over(w).alias("before"),
        F.lead("session").over(w).alias("next_session"), F.lead(cutoff).over(w).alias("next_cutoff"), F.col("close_at").alias("next_window_start"),
    )
    days = F.explode(F.sequence(F.date_add("before", 1), F.col("session")))
    return ordered.filter("before is not null").select(days.alias("calendar_day"), "*").drop("before")


def align_articles(articles: DataFrame, at: str, windows: DataFrame) -> DataFrame:
    """Articles with their session: the one on or after their New York day if published by its cutoff, else the next.

    ``at`` is a UTC time without zone. The window and the time from which the
    article may be used come along; articles without a time get none. The
    calendar is joined on the day, one row per day.
    """
    local = F.from_utc_timestamp(F.col(at).cast("timestamp"), "America/New_York")
    dated = articles.withColumn("calendar_day", F.to_date(local))
    joined = dated.join(F.broadcast(windows), "calendar_day", "left")
    in_time = F.col(at) <= F.col("cutoff")
    return joined.select(
        *articles.columns,
        F.when(in_time, F.col("session")).otherwise(F.col("next_session")).alias("session"),
        F.when(in_time, F.col("window_start")).otherwise(F.col("next_window_start")).alias("window_start"),
        F.when(in_time, F.col("cutoff")).otherwise(F.col("next_cutoff")).alias("available_at"),
    )


def align_days(counts: DataFrame, day: str, windows: DataFrame) -> DataFrame:
    """Day counts with the first session strictly after their day, available at that session's New York midnight."""
    after = windows.select(F.date_sub("calendar_day", 1).alias(day), F.col("session").alias("session"))
    midnight = F.to_utc_timestamp(F.col("session").cast("timestamp"), "America/New_York").cast("timestamp_ntz")
    return counts.join(F.broadcast(after), day, "left").withColumn("available_at", midnight)
