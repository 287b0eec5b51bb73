"""Rollups by day, hour, page, name and session; merging them to coarser grains; and metrics read from them.

Each rollup has two forms. The *exact* form counts distinct users for its own grain; such numbers
cannot be added up. The *partial* form carries mergeable sketches instead: partials of different
batches or finer grains are combined by ``merge_rollup`` without reading events again. The name of a
sketch column tells its kind: ``_sketch`` counts distinct values, ``_theta`` is a set of users that can be
intersected (``operators/retention.py``), ``_top`` holds the most frequent values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrain.functions.periods import AsOf, as_of_column, period_start, preset_days
from pulsegrain.functions.props import prop
from pulsegrain.operators.filters import for_project
from pulsegrain.operators.metrics import PAGE_VIEW, counts_users_sessions
from pulsegrain.operators.paging import top_n

SKETCH_LG_K = 12
# Values a top list keeps count of. While there are no more than three quarters as many, counts are exact; beyond that
# they are too high by at most 3.5 / TOP_ITEMS of all counted rows.
TOP_ITEMS = 4096


@dataclass(frozen=True)
class Rollup:
    """Keys of a rollup (name -> expression), its count column, and its distinct columns."""

    keys: dict[str, Column]
    count: str
    users: str
    sessions: str | None = None
    only: str | None = None
    sketches: dict[str, str] = field(default_factory=dict)
    tops: dict[str, Column] = field(default_factory=dict)


def rollup_specs() -> dict[str, Rollup]:
    """The counting rollups. A function, because columns need a running session.

    ``top_lists`` and ``minutes`` have few rows, whatever the number of names and pages; ``activity`` is for retention.
    """
    project, name, date = F.col("project_id"), F.col("event_name"), F.to_date("timestamp")
    both = {"users_sketch": "user_id", "sessions_sketch": "session_id"}
    page = F.when((name == PAGE_VIEW) & (prop("page") != ""), prop("page"))
    return {
        "page_views": Rollup({"project_id": project, "date": date, "page": prop("page")},
                             "views", "unique_users", "unique_sessions", PAGE_VIEW, both),
        "daily": Rollup({"project_id": project, "date": date},
                        "total_events", "active_users", "sessions", None, both),
        "event_names": Rollup({"project_id": project, "event_name": name, "date": date},
                              "event_count", "unique_users", None, None, {"users_sketch": "user_id"}),
        "hourly": Rollup({"project_id": project, "hour": F.date_trunc("hour", "timestamp"), "event_name": name},
                         "event_count", "unique_users", "unique_sessions", None, both),
        "top_lists": Rollup({"project_id": project, "date": date},
                            "total_events", "active_users", "sessions", None, both, {"events_top": name, "pages_top": page}),
        "minutes": Rollup({"project_id": project, "minute": F.date_trunc("minute", "timestamp")},
                          "total_events", "active_users", "sessions", None, both, {"events_top": name}),
        "activity": Rollup({"project_id": project, "date": date},
                           "total_events", "active_users", None, None, {"users_theta": "user_id"}),
    }


def _rows(events: DataFrame, spec: Rollup) -> DataFrame:
    rows = events if spec.only is None else events.filter(F.col("event_name") == spec.only)
    who = ["user_id"] + (["session_id"] if spec.sessions else [])
    return rows.select(*[c.alias(n) for n, c in spec.keys.items()], *who, *[c.alias(n) for n, c in spec.tops.items()])


def rollup_exact(events: DataFrame, name: str) -> DataFrame:
    spec = rollup_specs()[name]
    return counts_users_sessions(_rows(events, spec), list(spec.keys), True, spec.count, spec.users, spec.sessions)


def _sketch(out: str, col: str, lg_k: int) -> Column:
    return (F.theta_sketch_agg if out.endswith("_theta") else F.hll_sketch_agg)(col, lg_k).alias(out)


def _unite(sketch: str, top_items: int) -> Column:
    if sketch.endswith("_top"):
        return F.call_function("approx_top_k_combine", F.col(sketch), F.lit(top_items)).alias(sketch)
    return (F.theta_union_agg if sketch.endswith("_theta") else F.hll_union_agg)(sketch).alias(sketch)


def rollup_partial(events: DataFrame, name: str, lg_k: int = SKETCH_LG_K, top_items: int = TOP_ITEMS) -> DataFrame:
    """Counts and sketches, for storing and merging. One aggregation, combined in the map tasks."""
    spec = rollup_specs()[name]
    tops = [F.expr(f"approx_top_k_accumulate(`{c}`, {top_items}) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in spec.tops]
    return _rows(events, spec).groupBy(*spec.keys).agg(
        F.count("*").alias(spec.count), *[_sketch(out, col, lg_k) for out, col in spec.sketches.items()], *tops)


def rollup_page_views(events: DataFrame) -> DataFrame:
    """Views, users and sessions by project, day and page."""
    return rollup_exact(events, "page_views")


def rollup_daily(events: DataFrame) -> DataFrame:
    """Users, sessions and events by project and day."""
    return rollup_exact(events, "daily")


def rollup_event_names(events: DataFrame) -> DataFrame:
    """Events and users by project, name and day."""
    return rollup_exact(events, "event_names")


def rollup_hourly(events: DataFrame) -> DataFrame:
    """Events, users and sessions by project, hour and name."""
    return rollup_exact(events, "hourly")


SESSION_KEYS = ("project_id", "user_id", "session_id", "platform", "country", "city")


def rollup_sessions(events: DataFrame) -> DataFrame:
    """Start, end, events and distinct pages per session, platform and place.

    Events are first reduced to one row per session and page, so counting pages needs no distinct.
    """
    page = F.when(F.col("event_name") == PAGE_VIEW, prop("page"))
    per_page = events.groupBy(*SESSION_KEYS, page.alias("_page")).agg(
        F.min("timestamp").alias("_start"), F.max("timestamp").alias("_end"), F.count("*").alias("_n"))
    return per_page.groupBy(*SESSION_KEYS).agg(
        F.min("_start").alias("session_start"), F.max("_end").alias("session_end"),
        F.sum("_n").alias("events_count"), F.count("_page").alias("pages_visited"))


def rollup_sessions_partial(events: DataFrame) -> DataFrame:
    """The mergeable form: pages as a sketch."""
    page = F.when(F.col("event_name") == PAGE_VIEW, prop("page"))
    return events.groupBy(*SESSION_KEYS).agg(
        F.min("timestamp").alias("session_start"), F.max("timestamp").alias("session_end"),
        F.count("*").alias("events_count"), F.hll_sketch_agg(page, SKETCH_LG_K).alias("pages_sketch"))


def merge_sessions(partials: DataFrame) -> DataFrame:
    """One row per session from the partial rows of several batches: min of starts, max of ends."""
    return partials.groupBy(*SESSION_KEYS).agg(
        F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"),
        F.sum("events_count").alias("events_count"), F.hll_union_agg("pages_sketch").alias("pages_sketch"))


def _sketches(partials: DataFrame) -> list[str]:
    return [c for c in partials.columns if c.endswith(("_sketch", "_theta", "_top"))]


def merge_rollup(partials: DataFrame, keys: Sequence[str], top_items: int = TOP_ITEMS) -> DataFrame:
    """Combine partial rows by coarser (or the same) keys: counts add, sketches unite.

    No partials give no row, also without keys: they are grouped by a constant then, as top lists cannot unite nothing.
    """
    counts = [f.name for f in partials.schema.fields
              if f.dataType.simpleString() == "bigint" and f.name not in {*keys, "batch_id"}]
    return partials.groupBy(*keys or [F.lit(1).alias("_all")]).agg(
        *[F.sum(c).alias(c) for c in counts], *[_unite(s, top_items) for s in _sketches(partials)]).drop("_all")


def with_estimates(merged: DataFrame) -> DataFrame:
    """Replace every ``<x>_sketch`` and ``<x>_theta`` column by the estimate ``approx_<x>``; top lists stay."""
    estimates = {"approx_" + s.rsplit("_", 1)[0]: (F.theta_sketch_estimate if s.endswith("_theta") else F.hll_sketch_estimate)(s)
                 for s in _sketches(merged) if not s.endswith("_top")}
    return merged.withColumns(estimates).drop(*[s for s in _sketches(merged) if not s.endswith("_top")])


def listed(merged: DataFrame, top: str, value: str, count: str, top_items: int = TOP_ITEMS) -> DataFrame:
    """The values of a top list as rows, with their counts; the list column is dropped."""
    tracked = F.call_function("approx_top_k_estimate", F.col(top), F.lit(top_items))
    rest = [c for c in merged.columns if c != top]
    rows = merged.select(*rest, F.inline(tracked))
    return rows.withColumnsRenamed({"item": value, "count": count})


def _days(partials: DataFrame, project_id: str | None, date_range: str, as_of: AsOf) -> DataFrame:
    """Partials of a project's whole days in a range; the newest stored day where ``as_of`` is None."""
    rows = for_project(partials, project_id)
    return rows.filter(F.col("date").between(*day_range(partials, date_range, as_of)))


def day_range(partials: DataFrame, date_range: str, as_of: AsOf) -> tuple[Column, Column]:
    """First and last day of a range that ends with the day of ``as_of``."""
    last = (partials.select(F.max("date").alias("last")).scalar() if as_of is None
            else F.to_date(as_of_column(partials, as_of)))
    return F.date_sub(last, preset_days(date_range) - 1), last


def top_events_from_rollup(top_lists: DataFrame, project_id: str | None, date_range: str = "30d", as_of: AsOf = None,
                           n: int = 10, top_items: int = TOP_ITEMS) -> DataFrame:
    """The ``n`` most frequent event names of whole days, from the ``top_lists`` partials: (event_name, event_count)."""
    merged = merge_rollup(_days(top_lists, project_id, date_range, as_of), [], top_items).select("events_top")
    return top_n(listed(merged, "events_top", "event_name", "event_count", top_items), "event_count", n, "event_name")


def top_pages_from_rollup(top_lists: DataFrame, project_id: str | None, date_range: str = "30d", as_of: AsOf = None,
                          n: int = 20, top_items: int = TOP_ITEMS) -> DataFrame:
    """The ``n`` most viewed pages of whole days, from the ``top_lists`` partials: (page, page_views)."""
    merged = merge_rollup(_days(top_lists, project_id, date_range, as_of), [], top_items).select("pages_top")
    return top_n(listed(merged, "pages_top", "page", "page_views", top_items), "page_views", n, "page")


def realtime_from_rollup(minutes: DataFrame, project_id: str | None, as_of: AsOf = None,
                         last: int = 5, k: int = 5, top_items: int = TOP_ITEMS) -> DataFrame:
    """Events, users, sessions and most frequent names of the ``last`` whole minutes up to ``as_of``'s, from the
    ``minutes`` partials: one row. None is the newest stored minute. Users and sessions are estimates."""
    end = (minutes.select(F.max("minute").alias("last")).scalar() if as_of is None
           else F.date_trunc("minute", as_of_column(minutes, as_of)))
    start = end - F.make_interval(mins=F.lit(last - 1))
    rows = for_project(minutes, project_id).filter(F.col("minute").between(start, end))
    merged = with_estimates(merge_rollup(rows, [], top_items))
    tracked = F.call_function("approx_top_k_estimate", F.col("events_top"), F.lit(top_items))
    ranked = F.slice(F.array_sort(F.transform(tracked, lambda e: F.struct((-e["count"]).alias("n"), e["item"].alias("v")))), 1, k)
    row = merged.withColumn("top_events", F.transform(ranked, lambda e: e["v"]))  # one row, or none
    return row.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(out) for c, out in (
        ("total_events", "events"), ("approx_users", "approx_users"), ("approx_sessions", "approx_sessions"))],
        F.coalesce(F.max("top_events"), F.array().cast("array<string>")).alias("top_events"))


def active_users_from_rollup(daily_partials: DataFrame, period: str = "monthly") -> DataFrame:
    """Events, users and sessions by project and period, read from the daily rollup only."""
    graded = daily_partials.withColumn("period_start", period_start("date", period))
    return with_estimates(merge_rollup(graded, ["project_id", "period_start"]))
