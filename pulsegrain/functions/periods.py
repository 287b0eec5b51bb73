"""Calendar periods, date-range presets and the reference instant of a query."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values.
PRESET_DAYS = {"1d": 1, "7d": 7, "30d": 30, "90d": 90}
DEFAULT_DAYS = 30
EXACT_DAYS = {"daily": 1, "weekly": 7, "monthly": 30}

AsOf = dt.datetime | Column | None


def preset_days(date_range: str) -> int:
    """Days of a preset; an unknown preset means 30 days."""
    return PRESET_DAYS.get(date_range, DEFAULT_DAYS)


def as_of_column(events: DataFrame, as_of: AsOf, back: dt.timedelta = dt.timedelta(0),
                 ts: str = "timestamp") -> Column:
    """The instant ``back`` before ``as_of``.

    ``as_of`` is a given instant, a given column, or None for the newest timestamp. The latter is
    a scalar subquery: lazy, evaluated before the main scan without a driver round trip. The
    subtraction happens inside it, so a filter compares a plain column with a plain value. On the stored table
    the newest month is found first, from footers alone, and only its times are read (``events.newest_instant`` opens
    no other month's files at all).
    """
    if as_of is None:
        if ts == "timestamp" and "event_month" in events.columns:
            month = events.select(F.max("event_month").alias("month")).scalar()
            events = events.filter(F.col("event_month") == month)
        return events.select((F.max(ts) - F.lit(back)).alias("as_of")).scalar()
    if isinstance(as_of, Column):
        return as_of - F.lit(back)
    return F.lit(as_of - back).cast("timestamp")


def period_start(ts: str | Column, period: str) -> Column:
    """First date of the day, week (Monday) or month the timestamp falls in."""
    date = F.to_date(ts)
    if period == "daily":
        return date
    if period == "weekly":
        return F.trunc(date, "week")
    if period == "monthly":
        return F.trunc(date, "month")
    raise ValueError(f"unknown period: {period}")


def period_index(first: Column, later: Column, period: str) -> Column:
    """Number of whole periods between two period starts."""
    if period == "monthly":
        return ((F.year(later) * 12 + F.month(later)) - (F.year(first) * 12 + F.month(first))).cast("int")
    return (F.datediff(later, first) / (7 if period == "weekly" else 1)).cast("int")


def time_bucket(ts: str | Column, width: dt.timedelta) -> Column:
    """Start of the fixed-width time slice a timestamp falls in, in microseconds.

    Used as a second grouping key, so that one user with very many rows is spread over many
    tasks instead of being sorted in one.
    """
    micros = F.unix_micros(ts)
    return micros - F.pmod(micros, F.lit(int(width / dt.timedelta(microseconds=1))).cast("bigint"))


def iso_text(ts: str | Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def month_key(ts: str | Column) -> Column:
    return F.date_format(ts, "yyyyMM")
