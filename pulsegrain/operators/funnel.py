"""Funnels: unordered (each step counted by itself) and ordered within a time window."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from pulsegrain.functions.numbers import percent
from pulsegrain.functions.periods import AsOf, time_bucket
from pulsegrain.operators.filters import for_project, in_segment, named, scoped


def _step_rows(wide: DataFrame, steps: Sequence[str], with_counts: bool) -> DataFrame:
    """Turn one row with ``u0, u1, ...`` (and ``n0, ...``) into one row per step with its rates."""
    entries = []
    for i, name in enumerate(steps):
        users, before, first = F.col(f"u{i}"), F.col(f"u{max(i - 1, 0)}"), F.col("u0")
        fields = [F.lit(i + 1).alias("step"), F.lit(name).alias("event_name")]
        if with_counts:
            fields.append(F.col(f"n{i}").alias("events"))
        fields += [users.alias("users"), percent(users, before).alias("conversion_rate"),
                   percent(users, first).alias("overall_conversion")]
        entries.append(F.struct(*fields))
    return wide.select(F.inline(F.array(*entries)))


def _check(steps: Sequence[str]) -> None:
    if len(steps) < 2:
        raise ValueError("At least 2 events required for funnel analysis")


def funnel(events: DataFrame, steps: Sequence[str], project_id: str | None, date_range: str = "30d",
           as_of: AsOf = None, segment: DataFrame | None = None) -> DataFrame:
    """Unordered funnel: events and users per step, rate against the previous and the first step.

    Steps are counted independently, so a rate above 100 % is possible. ``segment`` is a frame of
    user ids (column ``id``) to restrict to. Events are first reduced to one row per name and
    user; the rest works on as many rows as there are steps.
    """
    _check(steps)
    rows = named(scoped(events, project_id, date_range, as_of), *steps)
    if segment is not None:
        rows = in_segment(rows, segment, F.lit(True))
    per_name = (rows.groupBy("event_name", "user_id").agg(F.count("*").alias("_n"))
                .groupBy("event_name").agg(F.sum("_n").alias("_n"), F.count("user_id").alias("_u")))
    wide = per_name.agg(*[
        F.coalesce(F.max(F.when(F.col("event_name") == name, F.col(col))), F.lit(0)).alias(f"{out}{i}")
        for i, name in enumerate(steps) for col, out in (("_n", "n"), ("_u", "u"))])
    return _step_rows(wide, steps, True)


def funnel_depth(events: DataFrame, steps: Sequence[str], within: dt.timedelta,
                 slice_width: dt.timedelta = dt.timedelta(days=1)) -> DataFrame:
    """Per user, the number of funnel steps reached in order, all within ``within`` of the first.

    A path starting late is always at least as good as one starting early, so for each step it is
    enough to know the latest start of any path that reached it. A user's history is cut into time
    slices and solved in two levels, so that no task sorts all rows of a very active user:

    1. inside a slice: the latest start per step of paths that begin there, and for every pair
       (i, j) the earliest moment at which a path that came in at step i reaches step j;
    2. over the slices of a user, one small row each: what earlier slices hand on.

    Both levels are running maxima; all steps share one sort per level. The result is exact.
    """
    _check(steps)
    k = len(steps)
    us = F.col("_us")
    rows = named(events, *steps).filter(F.col("user_id").isNotNull()).select(
        "user_id", "event_name", "id", F.unix_micros("timestamp").alias("_us"),
        time_bucket("timestamp", slice_width).alias("_slice"))

    inner = (Window.partitionBy("user_id", "_slice").orderBy("_us", "id")
             .rowsBetween(Window.unboundedPreceding, -1))
    is_step = [F.col("event_name") == name for name in steps]
    # s{j}: latest start of a path beginning in this slice and reaching step j at this row.
    # r{i}_{j}: 1 where a path entering the slice at step i reaches step j at this row.
    current = rows.withColumn("s0", F.when(is_step[0], us))
    for j in range(1, k):
        layer = {f"s{j}": F.when(is_step[j], F.max(f"s{j - 1}").over(inner)),
                 f"r{j - 1}_{j}": F.when(is_step[j], F.lit(1))}
        for i in range(j - 1):
            layer[f"r{i}_{j}"] = F.when(is_step[j], F.max(f"r{i}_{j - 1}").over(inner))
        current = current.withColumns(layer)

    limit_us = int(within / dt.timedelta(microseconds=1))
    pairs = [(i, j) for j in range(1, k) for i in range(j)]
    slices = current.groupBy("user_id", "_slice").agg(
        *[F.max(f"s{j}").alias(f"L{j}") for j in range(k)],
        *[F.max(F.coalesce(us - F.col(f"s{j}") <= limit_us, F.lit(False))).alias(f"D{j}") for j in range(k)],
        *[F.min(F.when(F.col(f"r{i}_{j}") == 1, us)).alias(f"T{i}_{j}") for i, j in pairs])

    outer = Window.partitionBy("user_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("C0", F.max("L0").over(outer))
    for j in range(1, k):
        carried = carried.withColumn(f"C{j}", F.max(F.array_max(F.array(
            F.col(f"L{j}"),
            *[F.when(F.col(f"T{i}_{j}").isNotNull(), F.col(f"C{i}")) for i in range(j)]))).over(outer))
    depth = F.lit(0)
    for j in range(k):
        reached = F.col(f"D{j}")
        for i in range(j):
            reached = reached | F.coalesce(F.col(f"T{i}_{j}") - F.col(f"C{i}") <= limit_us, F.lit(False))
        depth = F.when(reached, F.lit(j + 1)).otherwise(depth)
    return carried.groupBy("user_id").agg(F.max(depth).alias("depth"))


def ordered_funnel(events: DataFrame, steps: Sequence[str], within: dt.timedelta, project_id: str | None = None,
                   slice_width: dt.timedelta = dt.timedelta(days=1)) -> DataFrame:
    """Ordered funnel: users who did the steps in order within the time; definition ours.

    Equal timestamps are ordered by event id.
    """
    depths = funnel_depth(for_project(events, project_id), steps, within, slice_width)
    wide = depths.agg(*[F.count_if(F.col("depth") > i).alias(f"u{i}") for i in range(len(steps))])
    return _step_rows(wide, steps, False)
