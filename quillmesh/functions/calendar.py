"""Trading sessions of the US equity calendar, computed from its rules and held as a small table."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession

FIRST_YEAR, LAST_YEAR = 2018, 2035
NEW_YORK = ZoneInfo("America/New_York")


def nth_weekday(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th weekday (Monday 0) of a month; n = -1 is the last."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def easter(year: int) -> date:
    """Easter Sunday by the anonymous Gregorian computus."""
    golden, century, rest = year % 19, year // 100, year % 100
    epact = (19 * golden + century - century // 4 - (century - (century + 8) // 25 + 1) // 3 + 15) % 30
    shift = (32 + 2 * (century % 4) + 2 * (rest // 4) - epact - rest % 4) % 7
    long = (golden + 11 * epact + 22 * shift) // 451
    month, day = divmod(epact + shift - 7 * long + 114, 31)
    return date(year, month, day + 1)


def observed(day: date) -> date:
    """A fixed holiday's observed day: Saturday moves to Friday, Sunday to Monday."""
    return day + timedelta({5: -1, 6: 1}.get(day.weekday(), 0))


def holidays(year: int) -> set[date]:
    fixed = [date(year, 1, 1), date(year, 7, 4), date(year, 12, 25)] + ([date(year, 6, 19)] if year >= 2022 else [])
    moving = [
        nth_weekday(year, 1, 0, 3), nth_weekday(year, 2, 0, 3), easter(year) - timedelta(2), nth_weekday(year, 5, 0, -1),
        nth_weekday(year, 9, 0, 1), nth_weekday(year, 11, 3, 4),
    ]
    # A day moved into another year is not observed.
    return {d for d in [*map(observed, fixed), *moving] if d.year == year}


def early_closes(year: int) -> set[date]:
    closed = holidays(year)
    days = {nth_weekday(year, 11, 3, 4) + timedelta(1)}
    eve, third = date(year, 12, 24), date(year, 7, 3)
    days |= {d for d in (eve,) if d.weekday() < 5 and d not in closed}
    days |= {d for d in (third,) if d.weekday() < 5 and d not in closed and date(year, 7, 4).weekday() < 5}
    return days


def sessions(first: date, last: date) -> list[date]:
    """Session days from first to last; years outside the computed range raise."""
    if first.year < FIRST_YEAR or last.year > LAST_YEAR:
        raise ValueError(f"calendar covers {FIRST_YEAR} to {LAST_YEAR}")
    closed = {d for y in range(first.year, last.year + 1) for d in holidays(y)}
    days = (first + timedelta(i) for i in range((last - first).days + 1))
    return [d for d in days if d.weekday() < 5 and d not in closed]


def _utc(day: date, clock: time) -> datetime:
    return datetime.combine(day, clock, NEW_YORK).astimezone(ZoneInfo("UTC")).replace(tzinfo=None)


def calendar_rows(first: date, last: date) -> list[tuple]:
    early = {d for y in range(first.year, last.year + 1) for d in early_closes(y)}
    return [(d, _utc(d, time(9, 30)), _utc(d, time(13 if d in early else 16, 0)), d in early) for d in sessions(first, last)]


def session_calendar(spark: SparkSession, first: date, last: date) -> DataFrame:
    """(session, open_at, close_at, early_close), times in UTC without zone; about 250 rows a year."""
    return spark.createDataFrame(
        calendar_rows(first, last), "session date, open_at timestamp_ntz, close_at timestamp_ntz, early_close boolean"
    )
