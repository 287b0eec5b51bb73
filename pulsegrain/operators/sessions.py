"""Sessions: splitting event histories by idle gaps, and statistics over sessions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from pulsegrain.functions.numbers import percent, rounded
from pulsegrain.functions.periods import time_bucket
from pulsegrain.functions.props import prop


def sessionize(events: DataFrame, gap: dt.timedelta = dt.timedelta(minutes=30)) -> DataFrame:
    """Number the sessions of each user: a new one starts after more than ``gap`` without events.

    Adds ``session_no`` (1, 2, ...) and ``session_id`` (``<user>-<no>``); definition ours.

    Time is cut into slices as wide as the gap. Two events of one slice are never more than the gap
    apart, so a session can only break between slices, and first and last time per user and slice
    are enough to find every break. Events are thus aggregated, in the map tasks already, instead
    of being sorted per user; the window runs over slices, of which a user has a bounded number.
    The numbers are joined back by user and slice, a key that divides even a very active user. If
    the slice table is small, Spark broadcasts it and the events are not shuffled at all.
    Events without a user id are kept, with no session.
    """
    rows = events.drop("session_id").withColumn("_slice", time_bucket("timestamp", gap))
    slices = rows.filter(F.col("user_id").isNotNull()).groupBy("user_id", "_slice").agg(F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"))
    order = Window.partitionBy("user_id").orderBy("_slice")
    breaks = F.coalesce((F.col("_first") - F.lag("_last").over(order)) > F.lit(gap), F.lit(True))
    numbered = (slices.withColumn("_new", breaks.cast("bigint"))
                .select("user_id", "_slice", F.sum("_new").over(
                    order.rowsBetween(Window.unboundedPreceding, 0)).alias("session_no")))
    return (rows.join(numbered, ["user_id", "_slice"], "left")
            .withColumn("session_id", F.concat("user_id", F.lit("-"), F.col("session_no").cast("string")))
            .drop("_slice"))


def session_table(events: DataFrame, page_view: str = "page_view") -> DataFrame:
    """One row per session: start, end, seconds, events and page views."""
    return (events.groupBy("session_id", "user_id")
            .agg(F.min("timestamp").alias("session_start"), F.max("timestamp").alias("session_end"),
                 F.count("*").alias("events_count"),
                 F.count_if(F.col("event_name") == page_view).alias("page_views"))
            .withColumn("duration_seconds",
                        F.round((F.unix_micros("session_end") - F.unix_micros("session_start")) / 1e6).cast("bigint")))


def session_stats(sessions: DataFrame, *dims: str) -> DataFrame:
    """Sessions, mean duration, mean events and pages, and bounce rate; definition ours.

    A bounce is a session of one event.
    """
    return sessions.groupBy(*dims).agg(
        F.count("*").alias("sessions"),
        rounded(F.avg("duration_seconds"), 2).alias("avg_duration_seconds"),
        F.max("duration_seconds").alias("max_duration_seconds"),
        rounded(F.avg("events_count"), 2).alias("avg_events"),
        rounded(F.avg("page_views"), 2).alias("avg_page_views"),
        percent(F.count_if(F.col("events_count") == 1), F.count("*")).alias("bounce_rate"))


def bounce_rate(events: DataFrame, page_view: str = "page_view") -> DataFrame:
    """Bounce rate per entry page: sessions whose only page view it was; definition ours.

    The entry page is the session's first page view.
    """
    views = events.filter(F.col("event_name") == page_view)
    sessions = views.groupBy("session_id").agg(
        F.min_by(prop("page"), F.struct("timestamp", "id")).alias("page"), F.count("*").alias("_views"))
    return sessions.filter(F.col("page") != "").groupBy("page").agg(
        F.count("*").alias("entries"), F.count_if(F.col("_views") == 1).alias("bounces"),
        percent(F.count_if(F.col("_views") == 1), F.count("*")).alias("bounce_rate"))
