"""Retention at an exact day distance, and cohort matrices by period index: from events, or from stored sketches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from pulsegrain.functions.numbers import percent
from pulsegrain.functions.periods import EXACT_DAYS, AsOf, as_of_column, period_index, period_start
from pulsegrain.operators.filters import between_instants, for_project

LOOKBACK_DAYS = 90


def user_periods(events: DataFrame, project_id: str | None, period: str, as_of: AsOf = None,
                 lookback_days: int | None = LOOKBACK_DAYS) -> DataFrame:
    """Distinct (user, active period) with the user's first active period.

    The first period is the first inside the lookback; ``lookback_days=None`` uses all history.
    Rows are reduced to user and period before any window, so a group in the window has at most
    as many rows as there are periods.
    """
    rows = for_project(events, project_id)
    if lookback_days is not None:
        back = dt.timedelta(days=lookback_days)
        rows = between_instants(rows, as_of_column(events, as_of, back), as_of_column(events, as_of))
    active = rows.select("user_id", period_start("timestamp", period).alias("activity_date")).distinct()
    return active.withColumn("first_seen_date", F.min("activity_date").over(Window.partitionBy("user_id")))


def _newest(table: DataFrame, newest: int | None) -> DataFrame:
    ordered = table.orderBy(F.col("first_seen_date").desc())
    return ordered if newest is None else ordered.limit(newest)


def retention(events: DataFrame, project_id: str | None, period: str = "daily", as_of: AsOf = None,
              lookback_days: int | None = LOOKBACK_DAYS, newest: int | None = None) -> DataFrame:
    """Cohort size, users active exactly 1, 7 or 30 days after the cohort date, and the rate.

    Monthly retention compares month starts, so it only sees months of 30 days; ``cohort_matrix``
    counts whole periods instead. Each (user, period) occurs once, so no distinct count is needed:
    a user is counted for the cohort on the row of the first period.
    """
    rows = user_periods(events, project_id, period, as_of, lookback_days)
    distance = F.datediff("activity_date", "first_seen_date")
    table = rows.groupBy("first_seen_date").agg(
        F.count_if(distance == 0).alias("cohort_size"),
        F.count_if(distance == EXACT_DAYS[period]).alias("retained_users"))
    return _newest(table.withColumn("retention_rate", percent(F.col("retained_users"), F.col("cohort_size"))), newest)


def retention_by_join(events: DataFrame, project_id: str | None, period: str = "daily", as_of: AsOf = None,
                      lookback_days: int | None = LOOKBACK_DAYS, newest: int | None = None) -> DataFrame:
    """The same table as ``retention``, by joining first-seen users to their activity."""
    rows = user_periods(events, project_id, period, as_of, lookback_days)
    first = rows.groupBy("user_id").agg(F.min("activity_date").alias("first_seen_date"))
    activity = rows.select("user_id", "activity_date")
    distance = F.datediff("activity_date", "first_seen_date")
    table = first.join(activity, "user_id", "left").groupBy("first_seen_date").agg(
        F.count_distinct("user_id").alias("cohort_size"),
        F.count_distinct(F.when(distance == EXACT_DAYS[period], F.col("user_id"))).alias("retained_users"))
    return _newest(table.withColumn("retention_rate", percent(F.col("retained_users"), F.col("cohort_size"))), newest)


def cohort_matrix(events: DataFrame, project_id: str | None = None, period: str = "monthly", as_of: AsOf = None,
                  lookback_days: int | None = None) -> DataFrame:
    """Users of each cohort active in the n-th period after their first, and the share; definition ours."""
    rows = user_periods(events, project_id, period, as_of, lookback_days)
    index = period_index(F.col("first_seen_date"), F.col("activity_date"), period)
    cells = (rows.groupBy(F.col("first_seen_date").alias("cohort"), index.alias("period_index"))
             .agg(F.count("*").alias("users")))
    size = F.max(F.when(F.col("period_index") == 0, F.col("users"))).over(Window.partitionBy("cohort"))
    return cells.withColumn("retention_rate", percent(F.col("users"), size))


def cohort_grid(matrix: DataFrame, periods: int) -> DataFrame:
    """The matrix with one column per period index, 0 to ``periods - 1``, and the later cells in ``later``.

    ``later`` is a map from period index to users, NULL where a cohort has none.
    """
    first = F.col("period_index") < periods
    cells = [F.max(F.when(F.col("period_index") == i, F.col("users"))).alias(str(i)) for i in range(periods)]
    rest = F.sort_array(F.collect_list(F.when(~first, F.struct("period_index", "users"))))  # one entry a period
    grid = matrix.groupBy("cohort").agg(*cells, rest.alias("later"))
    return grid.withColumn("later", F.when(F.size("later") > 0, F.map_from_entries("later")))


def _period_sets(activity: DataFrame, project_id: str | None, period: str, since: dt.date | None) -> DataFrame:
    """(cohort, active, first): the users of each period as a set sketch, and those of them not seen before it.

    ``activity`` are partials of the rollup of that name. There is one row a period in the window.
    """
    rows = for_project(activity, project_id)
    if since is not None:
        rows = rows.filter(F.col("date") >= F.lit(since))
    sets = rows.groupBy(period_start("date", period).alias("cohort")).agg(F.theta_union_agg("users_theta").alias("active"))
    before = Window.partitionBy(F.lit(1)).orderBy("cohort").rowsBetween(Window.unboundedPreceding, -1)
    seen = sets.withColumn("seen", F.theta_union_agg("active").over(before))
    return seen.select("cohort", "active", F.when(F.col("seen").isNull(), F.col("active"))
                       .otherwise(F.theta_difference("active", F.col("seen"))).alias("first"))


def retention_from_sketches(activity: DataFrame, project_id: str | None, period: str = "daily", since: dt.date | None = None) -> DataFrame:
    """The table of ``retention`` from stored set sketches: events are not read again, and a new day adds one row of partials.

    A cohort is a period's set without the sets of earlier periods (from ``since`` on); who came back is the intersection
    of that with a later period's set. Numbers are exact as long as the project has fewer users than the sketch has
    entries; beyond, the error of each is about the number of all users seen so far, divided by the root of the entries.
    """
    sets = _period_sets(activity, project_id, period, since)
    later = sets.select(F.date_sub("cohort", EXACT_DAYS[period]).alias("cohort"), F.col("active").alias("back"))
    table = sets.join(later, "cohort", "left").select(
        F.col("cohort").alias("first_seen_date"), F.theta_sketch_estimate("first").alias("cohort_size"),
        F.when(F.col("back").isNull(), F.lit(0)).otherwise(F.theta_sketch_estimate(F.theta_intersection("first", "back"))).alias("retained_users"))
    table = table.filter("cohort_size > 0")
    return _newest(table.withColumn("retention_rate", percent(F.col("retained_users"), F.col("cohort_size"))), None)


def cohort_matrix_from_sketches(activity: DataFrame, project_id: str | None = None, period: str = "monthly", since: dt.date | None = None) -> DataFrame:
    """The table of ``cohort_matrix`` from stored set sketches (see ``retention_from_sketches``)."""
    sets = _period_sets(activity, project_id, period, since)
    reach = sets.agg(F.max("cohort").alias("last")).select("last").scalar()
    step = {"daily": F.expr("INTERVAL 1 DAY"), "weekly": F.expr("INTERVAL 7 DAYS"), "monthly": F.expr("INTERVAL 1 MONTH")}[period]
    cells = sets.select("cohort", "first", F.explode(F.sequence("cohort", reach, step)).alias("later"))
    back = sets.select(F.col("cohort").alias("later"), "active")
    users = F.theta_sketch_estimate(F.theta_intersection("first", "active"))
    table = cells.join(back, "later").select("cohort", period_index(F.col("cohort"), F.col("later"), period).alias("period_index"),
                                             users.alias("users"), F.theta_sketch_estimate("first").alias("_size")).filter("users > 0")
    return table.withColumn("retention_rate", percent(F.col("users"), F.col("_size"))).drop("_size")
