"""Per-user and per-key summaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from pulsegrain.functions.numbers import ratio, rounded
from pulsegrain.functions.periods import AsOf, as_of_column


def user_profile(events: DataFrame, as_of: AsOf = None, active_days: int = 30) -> DataFrame:
    """First and last seen, events, and whether seen in the last ``active_days`` days."""
    recent = as_of_column(events, as_of, dt.timedelta(days=active_days))
    return (events.groupBy("user_id")
            .agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
                 F.count("*").alias("events_count"))
            .withColumn("is_active", F.col("last_seen") >= recent))


def touch_users(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Users with first and last seen widened by the profiles of new events."""
    seen = profiles.select(F.col("user_id").alias("id"), F.col("first_seen").alias("_first"), F.col("last_seen").alias("_last"))
    return (users.join(seen, "id", "left")
            .withColumns({"first_seen": F.least("first_seen", "_first"), "last_seen": F.greatest("last_seen", "_last")})
            .select(users.columns))


def key_last_used(events: DataFrame, key: str = "api_key") -> DataFrame:
    """Newest use of each API key, by the hash under which keys are stored."""
    return (events.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.max("timestamp").alias("last_used_at"), F.count("*").alias("uses"))
            .select(F.sha2(F.col(key), 256).alias("key_hash"), "last_used_at", "uses"))


def touch_keys(api_keys: DataFrame, uses: DataFrame) -> DataFrame:
    """Keys with their last use moved on by ``uses`` (``key_last_used`` of new events); keys with one hash move together."""
    seen = uses.groupBy("key_hash").agg(F.max("last_used_at").alias("_last"))
    return (api_keys.join(seen, "key_hash", "left").withColumn("last_used_at", F.greatest("last_used_at", "_last"))
            .select(api_keys.columns))


def events_tracked(events: DataFrame) -> DataFrame:
    """Events accepted per project and name."""
    return events.groupBy("project_id", "event_name").agg(F.count("*").alias("events_tracked_total"))


def inactive_users(events: DataFrame, n_days: int = 7, as_of: AsOf = None) -> DataFrame:
    """Users without an event in the last ``n_days`` days; definition ours."""
    limit = as_of_column(events, as_of, dt.timedelta(days=n_days))
    now = as_of_column(events, as_of)
    return (events.groupBy("user_id").agg(F.max("timestamp").alias("last_seen")).filter(F.col("last_seen") < limit)
            .withColumn("days_inactive", F.datediff(F.to_date(now), F.to_date("last_seen"))))


def churn_risk(events: DataFrame, as_of: AsOf = None, factor: float = 1.0) -> DataFrame:
    """Users idle longer than ``factor`` times their usual gap between events; definition ours.

    The mean of consecutive gaps is (last - first) / (n - 1), so no sorting of histories is needed.
    """
    now = as_of_column(events, as_of)
    spans = events.groupBy("user_id").agg(
        F.min("timestamp").alias("_first"), F.max("timestamp").alias("last_seen"), F.count("*").alias("events"))
    mean_gap = F.try_divide((F.unix_micros("last_seen") - F.unix_micros("_first")) / 3.6e9, F.col("events") - 1)
    idle = (F.unix_micros(now) - F.unix_micros("last_seen")) / 3.6e9
    return spans.select(
        "user_id", "events", "last_seen", rounded(mean_gap, 2).alias("mean_gap_hours"),
        rounded(idle, 2).alias("idle_hours"), F.coalesce(idle > mean_gap * factor, F.lit(False)).alias("at_risk"))


def stickiness(events: DataFrame, window_days: int = 30) -> DataFrame:
    """Per project and day: users of the day, of the trailing 30 days, and their ratio; definition ours.

    Each active day of a user keeps the user in the trailing count for ``window_days`` days. These
    intervals are made disjoint with the user's next active day, and become a +1 and a -1 on the
    calendar, so the trailing count is a running sum of one small row per day. Nothing is
    multiplied by the window length, and no distinct count over it is needed.
    """
    active = events.select("project_id", "user_id", F.to_date("timestamp").alias("date")).distinct()
    own = Window.partitionBy("project_id", "user_id").orderBy("date")
    leaves = F.least(F.date_add("date", window_days), F.lead("date").over(own))
    moves = (active.withColumn("_leaves", F.coalesce(leaves, F.date_add("date", window_days)))
             .select("project_id", F.inline(F.array(
                 F.struct(F.col("date").alias("date"), F.lit(1).alias("dau"), F.lit(1).alias("delta")),
                 F.struct(F.col("_leaves").alias("date"), F.lit(0).alias("dau"), F.lit(-1).alias("delta"))))))
    per_day = moves.groupBy("project_id", "date").agg(F.sum("dau").alias("dau"), F.sum("delta").alias("delta"))
    calendar = Window.partitionBy("project_id").orderBy("date")
    last_day = F.max(F.when(F.col("dau") > 0, F.col("date"))).over(Window.partitionBy("project_id"))
    running = (per_day.withColumns({
        "mau": F.sum("delta").over(calendar.rowsBetween(Window.unboundedPreceding, 0)),
        "_until": F.coalesce(F.date_sub(F.lead("date").over(calendar), 1), F.col("date")), "_last": last_day})
        .filter(F.col("date") <= F.col("_last")))
    # Days on which nothing changed repeat the trailing count of the day before them.
    filled = running.select("project_id", F.explode(F.sequence("date", F.least("_until", "_last"))).alias("day"),
                            "date", "dau", "mau")
    dau = F.when(F.col("day") == F.col("date"), F.col("dau")).otherwise(F.lit(0))
    return filled.select("project_id", F.col("day").alias("date"), dau.alias("dau"), "mau",
                         ratio(dau, F.col("mau"), 4).alias("stickiness"))
