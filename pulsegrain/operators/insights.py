"""Change, trend, anomaly and forecast over small daily series, and period reports.

All definitions here are ours. Events are aggregated to one row per project and day (or period)
before any window, so a window group holds as many rows as there are days. Windows go by the calendar, not by
rows: a day without events is no value, and is not replaced by an earlier one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrain.functions.numbers import rounded
from pulsegrain.functions.periods import period_start
from pulsegrain.operators.metrics import counts_users_sessions


def daily_series(events: DataFrame) -> DataFrame:
    """Events, users and sessions per project and day."""
    return counts_users_sessions(events.withColumn("date", F.to_date("timestamp")), ["project_id", "date"])


def change_percent(now: Column, before: Column) -> Column:
    """Change in percent, NULL when there is no value before or it is zero."""
    return rounded(F.try_divide((now - before).cast("double"), before.cast("double")) * 100, 2)


def period_number(date: str, period: str) -> Column:
    """Number of the day, week or month that starts at a date; neighbours differ by one."""
    if period == "monthly":
        return (F.year(date) * 12 + F.month(date)).cast("int")
    days = F.unix_date(F.to_date(date))
    return F.floor(days / 7).cast("int") if period == "weekly" else days


def vs_previous(df: DataFrame, metrics: Sequence[str], order: str, keys: Sequence[str] = ("project_id",),
                period: str = "daily") -> DataFrame:
    """Add ``previous_<m>`` and ``<m>_change`` against the day, week or month before, per key; NULL if it has no row."""
    before = Window.partitionBy(*keys).orderBy(period_number(order, period)).rangeBetween(-1, -1)
    out = df.withColumns({f"previous_{m}": F.max(m).over(before) for m in metrics})
    return out.withColumns({f"{m}_change": change_percent(F.col(m), F.col(f"previous_{m}")) for m in metrics})


def trend(daily: DataFrame, metric: str, days: int = 7, threshold: float = 20.0) -> DataFrame:
    """Mean of the last ``days`` days against the ``days`` before; flagged from ``threshold`` percent.

    Days without two full windows are left out.
    """
    w = Window.partitionBy("project_id").orderBy(period_number("date", "daily"))
    now, before = w.rangeBetween(1 - days, 0), w.rangeBetween(1 - 2 * days, -days)
    means = daily.select(
        "project_id", "date", F.avg(metric).over(now).alias("_now"), F.avg(metric).over(before).alias("_before"),
        (F.count("*").over(before) + F.count("*").over(now)).alias("_rows")).filter(F.col("_rows") == 2 * days)
    change = change_percent(F.col("_now"), F.col("_before"))
    return means.select(
        "project_id", "date", rounded(F.col("_now"), 4).alias("trailing_avg"), rounded(F.col("_before"), 4).alias("prior_avg"),
        change.alias("change"), F.when(change >= threshold, "up").when(change <= -threshold, "down")
        .otherwise("flat").alias("trend"))


def anomalies(daily: DataFrame, metric: str, z: float = 3.0, days: int = 7) -> DataFrame:
    """z-score of each day against the ``days`` days before it, if all have values; flagged from ``z`` on."""
    before = Window.partitionBy("project_id").orderBy(period_number("date", "daily")).rangeBetween(-days, -1)
    full = F.count("*").over(before) == days
    mean, spread = (F.when(full, value(metric).over(before)) for value in (F.avg, F.stddev_samp))
    scored = daily.select("project_id", "date", F.col(metric).alias("value"), mean.alias("_m"), spread.alias("_s"))
    score = rounded(F.try_divide(F.col("value") - F.col("_m"), F.col("_s")), 4)
    return scored.select("project_id", "date", "value", rounded(F.col("_m"), 4).alias("expected"), score.alias("z_score"),
                         F.coalesce(F.abs(score) >= z, F.lit(False)).alias("is_anomaly"))


def forecast(daily: DataFrame, metric: str, horizon: int = 7) -> DataFrame:
    """Straight-line forecast of a daily metric for the next ``horizon`` days, per project."""
    first = F.min("date").over(Window.partitionBy("project_id"))
    points = daily.withColumn("_x", F.datediff("date", first).cast("double"))
    fit = points.groupBy("project_id").agg(
        F.regr_slope(metric, "_x").alias("_slope"), F.regr_intercept(metric, "_x").alias("_base"),
        F.max("_x").alias("_last_x"), F.max("date").alias("_last"))
    ahead = fit.withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return ahead.select(
        "project_id", F.date_add("_last", F.col("_step")).alias("date"),
        rounded(F.col("_base") + F.col("_slope") * (F.col("_last_x") + F.col("_step")), 4).alias("forecast"))


def period_report(events: DataFrame, period: str = "weekly") -> DataFrame:
    """Per project and period: events, users, sessions, each with its change, and the top event.

    Events are read once: tasks reduce them to one row per name, one per user and one per session of a period.
    """
    keys = ["project_id", "period_start"]
    kinds = ["event_name", "user_id", "session_id"]
    rows = events.select("project_id", period_start("timestamp", period).alias("period_start"), *kinds)
    reduced = rows.groupingSets([[*keys, kind] for kind in kinds], *keys, *kinds).agg(
        F.count("*").alias("_n"), *(F.grouping(kind).alias(f"_no_{kind}") for kind in kinds))
    of = lambda kind: F.col(f"_no_{kind}") == 0
    counts = reduced.groupBy(*keys).agg(
        F.sum(F.when(of("event_name"), F.col("_n"))).alias("events"),
        F.count(F.when(of("user_id"), F.col("user_id"))).alias("users"),
        F.count(F.when(of("session_id"), F.col("session_id"))).alias("sessions"),
        F.min_by("event_name", F.when(of("event_name"), F.struct(-F.col("_n"), "event_name"))).alias("top_event"))
    out = vs_previous(counts, ["events", "users", "sessions"], "period_start", period=period)
    return out.select(*(c for c in out.columns if c != "top_event"), "top_event")
