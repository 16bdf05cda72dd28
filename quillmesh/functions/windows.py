"""Date windows, week buckets, and how precise a publication time is."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days of the named windows.
PRESETS = {"last_7_days": 7, "last_30_days": 30, "last_90_days": 90}


def resolve_window(window: dict | None, today: date) -> tuple[date, date]:
    """First and last day, both inside: explicit ``start`` and ``end`` before a ``preset`` that ends today.

    One explicit end, an unknown preset or an inverted window raises ValueError.
    """
    window = window or {}
    start, end = window.get("start"), window.get("end")
    if (start is None) != (end is None):
        raise ValueError("a window of explicit dates needs both ends")
    if start is None:
        days = PRESETS.get(window.get("preset", "last_30_days"))
        if days is None:
            raise ValueError(f"no such window: {window['preset']}")
        return today - timedelta(days=days - 1), today
    first, last = (d if isinstance(d, date) else date.fromisoformat(str(d)) for d in (start, end))
    if first > last:
        raise ValueError(f"the window begins {first} and ends {last}")
    return first, last


def in_days(stamp: Column, start: date, end: date) -> Column:
    """Whether a 14-digit number yyyymmddHHMMSS lies in the days from start to end; a plain range, so it reaches the scan."""
    bound = lambda d, clock: int(d.strftime("%Y%m%d")) * 1_000_000 + clock
    return stamp.between(bound(start, 0), bound(end, 235_959))


def iso_week(day: Column) -> Column:
    """``YYYY-Www`` of a date by its ISO year and week; null for null."""
    year = F.extract(F.lit("YEAROFWEEK"), day).cast("string")
    return F.when(day.isNotNull(), F.concat(year, F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0")))


def precision(at: Column, source: Column) -> Column:
    """How exact a publication time is: missing, date, minute or second.

    Midnight counts as a bare date when the source's name says ``date``, or
    when it says nothing of time, minute or second.
    """
    named = F.lower(F.coalesce(source, F.lit("")))
    says = lambda word: F.contains(named, F.lit(word))
    midnight = (F.hour(at) == 0) & (F.minute(at) == 0)
    day = midnight & (says("date") | ((F.second(at) == 0) & ~says("time"))) & ~says("minute") & ~says("second")
    return (
        F.when(at.isNull(), "missing").when(day, "date").when(F.second(at) != 0, "second")
        .when((F.minute(at) != 0) | says("minute"), "minute").otherwise("second")
    )


def hours_between(first: Column, last: Column) -> Column:
    """Hours from one timestamp to another."""
    return (F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 3_600_000_000.0
