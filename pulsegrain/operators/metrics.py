"""Headline metrics: overview, top events, active users, pages, real-time snapshot.

Every metric takes the project first; None means all projects together. ``as_of`` is the end of
the range (None: the newest event). With ``exact=False`` distinct counts are approximate and
need a single aggregation.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrain.functions.numbers import percent, ratio, rounded
from pulsegrain.functions.periods import AsOf, period_start
from pulsegrain.functions.props import prop, prop_num
from pulsegrain.operators.filters import for_project, has_prop, named, scoped, trailing
from pulsegrain.operators.paging import paginate, top_n

PAGE_VIEW = "page_view"


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def distinct_where(value: str | Column, condition: Column) -> Column:
    return F.count_distinct(F.when(condition, F.col(value) if isinstance(value, str) else value))


def approx_users(value: str = "user_id", rsd: float = 0.02) -> Column:
    return F.approx_count_distinct(value, rsd)


def counts_users_sessions(events: DataFrame, keys: Sequence[str | Column], exact: bool = True,
                          count: str = "events", users: str = "users", sessions: str | None = "sessions",
                          sums: dict[str, Column] | None = None) -> DataFrame:
    """Per key: number of events, distinct users, distinct sessions, and extra sums.

    Tasks reduce events to one row per key and user and one per key and session, which are shuffled once and then
    only counted. A key, user or session with very many events has already collapsed in the map tasks, and no second
    shuffle is needed for the distinct counts.
    """
    sums = sums or {}
    if not exact:
        wanted = [approx_users("user_id").alias(users)]
        if sessions:
            wanted.append(approx_users("session_id").alias(sessions))
        return events.groupBy(*keys).agg(
            F.count("*").alias(count), *wanted, *[F.sum(c).alias(n) for n, c in sums.items()])
    names = [k if isinstance(k, str) else f"_k{i}" for i, k in enumerate(keys)]
    keyed = [F.col(k) if isinstance(k, str) else k for k in keys]
    who = {"user_id": users} | ({"session_id": sessions} if sessions else {})
    rows = events.select(*[k.alias(n) for k, n in zip(keyed, names)], *who, *[c.alias(n) for n, c in sums.items()])
    reduced = rows.groupingSets([[*names, kind] for kind in who], *names, *who).agg(
        F.count("*").alias("_n"), *[F.sum(n).alias(n) for n in sums], *[F.grouping(kind).alias(f"_no_{kind}") for kind in who])

    def of(kind: str, value: str) -> Column:
        return F.when(F.col(f"_no_{kind}") == 0, F.col(value))

    return reduced.groupBy(*names).agg(
        F.coalesce(F.sum(of("user_id", "_n")), F.lit(0)).alias(count),
        *[F.count(of(kind, kind)).alias(name) for kind, name in who.items()],
        *[F.sum(of("user_id", n)).alias(n) for n in sums])


def overview(events: DataFrame, project_id: str | None, date_range: str = "30d", as_of: AsOf = None,
             exact: bool = True) -> DataFrame:
    """Total events, unique users, sessions, page views, events per session: one row."""
    rows = scoped(events, project_id, date_range, as_of)
    is_view = (F.col("event_name") == PAGE_VIEW).cast("bigint")
    return (counts_users_sessions(rows, [], exact, "total_events", "unique_users", "sessions",
                                  {"page_views": is_view})
            .withColumn("page_views", F.coalesce("page_views", F.lit(0)))
            .withColumn("avg_events_per_session", ratio(F.col("total_events"), F.col("sessions"), 2)))


def event_counts(events: DataFrame, exact: bool = True) -> DataFrame:
    """Events and unique users per event name."""
    return counts_users_sessions(events, ["event_name"], exact, "event_count", "unique_users", None)


def top_events(events: DataFrame, project_id: str | None, date_range: str = "30d", as_of: AsOf = None,
               n: int = 10, exact: bool = True) -> DataFrame:
    """The ``n`` most frequent event names with their users."""
    return top_n(event_counts(scoped(events, project_id, date_range, as_of), exact), "event_count", n, "event_name")


def daily_active_users(events: DataFrame, project_id: str | None, date_range: str = "30d", as_of: AsOf = None,
                       exact: bool = True) -> DataFrame:
    """Active users and sessions per day."""
    rows = scoped(events, project_id, date_range, as_of).withColumn("date", F.to_date("timestamp"))
    return (counts_users_sessions(rows, ["date"], exact, "_n", "active_users", "sessions")
            .drop("_n").orderBy("date"))


def active_users(events: DataFrame, period: str = "weekly", exact: bool = True) -> DataFrame:
    """Active users, sessions and events per day, week or month (weekly, monthly: definition ours)."""
    rows = events.withColumn("period_start", period_start("timestamp", period))
    return counts_users_sessions(rows, ["period_start"], exact, "events", "active_users", "sessions")


def total_events(events: DataFrame, project_id: str | None, date_range: str = "30d", as_of: AsOf = None) -> DataFrame:
    return scoped(events, project_id, date_range, as_of).agg(F.count("*").alias("total_events"))


def common_events(events: DataFrame, project_id: str | None, as_of: AsOf = None, n: int = 10) -> DataFrame:
    """The most common event names of the last seven days."""
    rows = for_project(trailing(events, dt.timedelta(days=7), as_of), project_id)
    return top_n(rows.groupBy("event_name").agg(F.count("*").alias("cnt")), "cnt", n, "event_name")


def top_pages(events: DataFrame, project_id: str | None, date_range: str = "30d", as_of: AsOf = None,
              page: int = 1, limit: int = 20, exact: bool = True) -> DataFrame:
    """Pages by views, with visitors, sessions and mean load time; one page of the list.

    ``has_more`` tells whether a later page has rows.
    """
    rows = has_prop(named(scoped(events, project_id, date_range, as_of), PAGE_VIEW), "page")
    load = prop_num("load_time")
    stats = counts_users_sessions(
        rows.withColumn("page", prop("page")), ["page"], exact, "page_views", "unique_visitors", "sessions",
        {"_load": load, "_loads": load.isNotNull().cast("bigint")})
    shaped = stats.select("page", "page_views", "unique_visitors", "sessions",
                          rounded(F.try_divide("_load", "_loads"), 2).alias("avg_load_time"))
    return paginate(shaped, [F.col("page_views").desc(), F.col("page")], page, limit)


def top_k_values(df: DataFrame, col: str, k: int, keys: Sequence[str] = (), alias: str = "top") -> DataFrame:
    """The ``k`` most frequent values per key as an array, ties by value.

    Values are counted first and cut to ``k`` per key by a group limit that also runs below the
    shuffle, so the array is never built from more than ``k`` entries.
    """
    counts = df.groupBy(*keys, col).agg(F.count("*").alias("_n"))
    order = [F.col("_n").desc(), F.col(col)]
    if keys:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        best = counts.withColumn("_rank", rank).filter(F.col("_rank") <= k)
    else:
        best = counts.orderBy(*order).limit(k)
    entry = F.struct((-F.col("_n")).alias("n"), F.col(col).alias("v"))
    return best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["v"]).alias(alias))


def top_k_approx(df: DataFrame, col: str, k: int, keys: Sequence[str] = (), alias: str = "top") -> DataFrame:
    """The probably most frequent values per key, by a bounded sketch in one aggregation."""
    picked = F.call_function("approx_top_k", F.col(col), F.lit(k))
    return df.groupBy(*keys).agg(F.transform(picked, lambda e: e["item"]).alias(alias))


def realtime_snapshot(events: DataFrame, project_id: str | None, as_of: AsOf = None,
                      interval: dt.timedelta = dt.timedelta(minutes=5), k: int = 5) -> DataFrame:
    """Events, users, sessions and most frequent names of the last minutes: one row."""
    rows = for_project(trailing(events, interval, as_of), project_id)
    totals = counts_users_sessions(rows, [], True, "events_last_5min", "active_users_last_5min",
                                   "active_sessions_last_5min")
    names = top_k_values(rows, "event_name", k, alias="top_events_last_5min")
    both = totals.unionByName(names, allowMissingColumns=True)
    return both.agg(
        F.max("events_last_5min").alias("events_last_5min"),
        F.max("active_users_last_5min").alias("active_users_last_5min"),
        F.max("active_sessions_last_5min").alias("active_sessions_last_5min"),
        F.coalesce(F.max("top_events_last_5min"), F.array().cast("array<string>")).alias("top_events_last_5min"))


def session_has(events: DataFrame, name: str, alias: str = "has_event") -> DataFrame:
    """Per session, whether the named event occurs; no list of names is collected."""
    return events.groupBy("session_id").agg(F.max(F.col("event_name") == name).alias(alias))


def conversion_by(events: DataFrame, goal: str, dim: str) -> DataFrame:
    """Users, users who reached the goal event, and the rate, per value of ``dim``; definition ours."""
    per_user = events.groupBy(dim, "user_id").agg(F.max((F.col("event_name") == goal).cast("int")).alias("_hit"))
    return per_user.groupBy(dim).agg(
        F.count("user_id").alias("users"), F.count_if((F.col("_hit") == 1) & F.col("user_id").isNotNull()).alias("converted"),
    ).withColumn("conversion_rate", percent(F.col("converted"), F.col("users")))


def event_engagement(events: DataFrame, project_id: str | None = None) -> DataFrame:
    """Events per user by event name; definition ours."""
    return event_counts(for_project(events, project_id)).withColumn(
        "events_per_user", ratio(F.col("event_count"), F.col("unique_users"), 2))


def breakdown(events: DataFrame, dims: Sequence[str], totals: bool = False) -> DataFrame:
    """Events, users and sessions by dimensions; ``totals`` adds subtotal rows (dimension NULL).

    Definition ours.
    """
    if not totals:
        return counts_users_sessions(events, list(dims))
    reduced = events.groupBy(*dims, "user_id", "session_id").agg(F.count("*").alias("_n"))
    return reduced.rollup(*dims).agg(
        F.sum("_n").alias("events"), F.count_distinct("user_id").alias("users"),
        F.count_distinct("session_id").alias("sessions"))


def breakdown_of(metric: Callable[[DataFrame], DataFrame], events: DataFrame, dim: str, values: Sequence[str]) -> DataFrame:
    """Any metric, once per listed value of a dimension, stacked; definition ours.

    One scan per value: ``breakdown_by`` takes one for all, where the metric is made per project.
    """
    parts = [metric(events.filter(F.col(dim) == v)).withColumn(dim, F.lit(v)) for v in values]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def breakdown_by(metric: Callable[[DataFrame], DataFrame], events: DataFrame, dim: str) -> DataFrame:
    """Any metric that is made per project, for every value of a dimension; definition ours.

    The metric runs once, and sees project and value together as the project.
    """
    out = metric(events.withColumn("project_id", F.struct("project_id", F.col(dim).alias("value"))))
    return out.select("project_id.project_id", F.col("project_id.value").alias(dim), *(c for c in out.columns if c not in ("project_id", dim)))


def experiment_readout(events: DataFrame, goal: str, control: str, key: str = "experiment") -> DataFrame:
    """Conversion by variant, difference to the control, and the two-proportion z; definition ours.

    The variant is a property of the events. The figures of the control are one row, a scalar of the same table of
    variants, so a property with very many values is not gathered in one task.
    """
    rows = has_prop(events, key).withColumn("variant", prop(key))
    table = conversion_by(rows, goal, "variant")
    # Made from all variants, not filtered from them: both readings then share one shuffle.
    is_control = F.col("variant") == control
    found = table.agg(F.struct(F.max(F.when(is_control, F.col("users"))).alias("users"),
                               F.max(F.when(is_control, F.col("converted"))).alias("converted")).alias("control")).scalar()
    n0, x0 = found["users"], found["converted"]
    n, x = F.col("users"), F.col("converted")
    p, p0 = ratio(x, n), ratio(x0, n0)
    pooled = ratio(x + x0, n + n0)
    error = F.sqrt(pooled * (1 - pooled) * (ratio(F.lit(1), n) + ratio(F.lit(1), n0)))
    return table.select(
        "variant", "users", "converted", "conversion_rate",
        rounded((p - p0) * 100, 2).alias("difference"),
        rounded(ratio(p - p0, error), 4).alias("z_score"))
