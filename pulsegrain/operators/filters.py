"""Row filters. All are plain predicates that reach the Parquet scan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrain.functions.periods import AsOf, as_of_column, month_key, preset_days
from pulsegrain.functions.props import prop


def for_project(df: DataFrame, project_id: str | None) -> DataFrame:
    """Rows of one project; None keeps all projects."""
    return df if project_id is None else df.filter(F.col("project_id") == project_id)


def between_instants(df: DataFrame, start: Column, end: Column, ts: str = "timestamp") -> DataFrame:
    """Rows in the closed time range. On the partitioned table the months are bounded too, so
    that whole folders are skipped."""
    out = df.filter((F.col(ts) >= start) & (F.col(ts) <= end))
    if "event_month" in df.columns:
        out = out.filter(F.col("event_month").between(month_key(start), month_key(end)))
    return out


def in_range(df: DataFrame, date_range: str = "30d", as_of: AsOf = None, ts: str = "timestamp") -> DataFrame:
    """The last 1, 7, 30 or 90 days up to ``as_of``, both ends included."""
    back = dt.timedelta(days=preset_days(date_range))
    return between_instants(df, as_of_column(df, as_of, back, ts), as_of_column(df, as_of, ts=ts), ts)


def trailing(df: DataFrame, interval: dt.timedelta, as_of: AsOf = None, ts: str = "timestamp") -> DataFrame:
    """The last ``interval`` up to ``as_of``."""
    return between_instants(df, as_of_column(df, as_of, interval, ts), as_of_column(df, as_of, ts=ts), ts)


def scoped(df: DataFrame, project_id: str | None, date_range: str = "30d", as_of: AsOf = None) -> DataFrame:
    """One project in one date range: the scope of every metric."""
    return for_project(in_range(df, date_range, as_of), project_id)


def named(df: DataFrame, *names: str) -> DataFrame:
    return df.filter(F.col("event_name").isin(*names))


def has_prop(df: DataFrame, key: str) -> DataFrame:
    """Rows whose property is present and not empty."""
    return df.filter(prop(key) != "")


def apply_filters(df: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    """Equality filters by column or, for names that are no column, by property (definition ours)."""
    tests = [(F.col(k) if k in df.columns else prop(k)) == F.lit(v) for k, v in filters.items()]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def in_segment(events: DataFrame, users: DataFrame, predicate: Column, user_key: str = "id") -> DataFrame:
    """Events of the users for whom ``predicate`` holds (definition ours)."""
    members = users.filter(predicate).select(F.col(user_key).alias("user_id"))
    return events.join(members, "user_id", "left_semi")


def active_rows(df: DataFrame, as_of: dt.datetime | Column, expires: str = "expires_at") -> DataFrame:
    """Active and unexpired rows; a row without expiry is not kept."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    return df.filter(F.col("is_active") & (F.col(expires) > now))
