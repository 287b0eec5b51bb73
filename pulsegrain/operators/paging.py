"""Sorted slices: recent rows, top rows, pages, row caps. Each limit is the feature itself."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from pulsegrain.functions.periods import month_key

MAX_PAGE = 1000
MAX_RECENT = 100
DEFAULT_RECENT = 10
MAX_ROWS = 10000
DEFAULT_ROWS = 100
CANDIDATE_LANES = 64


def first_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group by a total order, in two rounds.

    Each task already drops all but its own first ``n`` rows of a group. With very many tasks, what
    is left of a large group is still too much for one task; so the candidates of a group first
    meet in ``CANDIDATE_LANES`` lanes, and only the winners of the lanes meet in one place. Which
    lane a row takes does not matter to the result.
    """
    lane = F.pmod(F.spark_partition_id(), F.lit(CANDIDATE_LANES))
    lanes = Window.partitionBy(*keys, "_lane").orderBy(*order)
    groups = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_lane", lane)
            .withColumn("_rank", F.row_number().over(lanes)).filter(F.col("_rank") <= n).drop("_lane", "_rank")
            .withColumn("_rank", F.row_number().over(groups)).filter(F.col("_rank") <= n).drop("_rank"))


def recent_per_project(events: DataFrame, n: int = MAX_RECENT) -> DataFrame:
    """Every project's ``n`` newest events."""
    return first_n_per_group(events, ["project_id"], [F.col("timestamp").desc(), F.col("id")], n)


def recent_events(events: DataFrame, project_id: str | None, limit: int = DEFAULT_RECENT) -> DataFrame:
    """A project's newest events (of any project: None), newest first; a limit above 100 is an error."""
    n = limit or DEFAULT_RECENT
    if n > MAX_RECENT:
        raise ValueError(f"limit must be at most {MAX_RECENT}")
    rows = events if project_id is None else events.filter(F.col("project_id") == project_id)
    return recent_per_project(rows, n).orderBy(F.col("timestamp").desc(), "id").limit(n)


def top_n(df: DataFrame, measure: str, n: int, tie: str) -> DataFrame:
    """The ``n`` rows with the largest measure, ties in the order of ``tie``."""
    return df.orderBy(F.col(measure).desc(), F.col(tie)).limit(n)


def paginate(df: DataFrame, order: Sequence[Column], page: int = 1, limit: int = 20) -> DataFrame:
    """One page of the sorted rows, with ``has_more``.

    ``order`` must be total. One row beyond the page is read to learn whether more follow, so a
    last page that is exactly full has ``has_more`` false. All rows before the page are sorted out too: use
    ``page_after`` to go deep. A limit above 1000 is an error.
    """
    page, limit = max(page or 1, 1), _page_size(limit)
    return _with_more(df.orderBy(*order).offset((page - 1) * limit).limit(limit + 1), order, limit)


def _page_size(limit: int | None) -> int:
    if (limit or 20) > MAX_PAGE:
        raise ValueError(f"limit must be at most {MAX_PAGE}")
    return limit or 20


def _with_more(ahead: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` of at most ``limit + 1`` rows, and whether there was one more."""
    whole = Window.partitionBy(F.lit(1))
    return (ahead.withColumns({"_size": F.count("*").over(whole),
                               "_place": F.row_number().over(whole.orderBy(*order))})
            .filter(F.col("_place") <= limit)
            .withColumn("has_more", F.col("_size") > limit).drop("_size", "_place"))


def page_after(df: DataFrame, order: Sequence[str], cursor: str | None = None, limit: int = 20) -> DataFrame:
    """The page that follows ``cursor``, with ``has_more`` and each row's own ``cursor``; without one, the first page.

    ``order`` names the columns of a total order, ``-name`` for descending; NULL comes first in ascending and last in
    descending columns. The cursor of a page's last row gives the next page. It becomes a filter that reaches the
    scan, on the stored event table by month too, so a page deep down costs no more than the first, and rows that
    arrive before the cursor shift nothing. A cursor of another order, or none at all, is an error.
    """
    limit = _page_size(limit)
    keys = [(name.removeprefix("-"), name.startswith("-")) for name in order]
    types = {f.name: f.dataType for f in df.schema.fields}
    for name, _ in keys:
        if not isinstance(types[name], (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            raise ValueError(f"cannot page by {name}: {types[name].simpleString()}")
    if cursor is not None:
        df = df.filter(_after(df, keys, types, _told(cursor, order)))
    sorts = [F.col(f"`{name}`").desc() if down else F.col(f"`{name}`").asc() for name, down in keys]
    texts = [F.unix_micros(name) if isinstance(types[name], T.TimestampType) else F.col(f"`{name}`") for name, _ in keys]
    made = F.struct(F.array(*map(F.lit, order)).alias("order"), F.array(*(t.cast("string") for t in texts)).alias("values"))
    return (_with_more(df.orderBy(*sorts).limit(limit + 1), sorts, limit)
            .withColumn("cursor", F.translate(F.base64(F.to_json(made).cast("binary")), "\r\n", "")))


def _told(cursor: str, order: Sequence[str]) -> list[str | None]:
    """The values that a cursor holds."""
    try:
        told = json.loads(base64.b64decode(cursor, validate=True))
        known, values = told["order"], told["values"]
    except (ValueError, KeyError, TypeError) as error:
        raise ValueError("unreadable cursor") from error
    if known != list(order) or len(values) != len(known):
        raise ValueError("the cursor belongs to another order")
    return values


def _after(df: DataFrame, keys: Sequence[tuple[str, bool]], types: dict[str, T.DataType], values: Sequence[str | None]) -> Column:
    """Rows behind the given values. The first column is bounded by itself too, as only such a filter prunes."""
    whole = F.lit(False)
    for (name, down), text in reversed(list(zip(keys, values))):
        col = F.col(f"`{name}`")
        if text is None:
            # NULL is the smallest value: first when ascending, last when descending.
            whole = (col.isNull() & whole) if down else col.isNotNull() | (col.isNull() & whole)
            bound = col.isNull() if down else F.lit(True)
        else:
            value = F.timestamp_micros(F.lit(int(text))) if isinstance(types[name], T.TimestampType) else F.lit(text).cast(types[name])
            behind = (col < value) | col.isNull() if down else col > value
            whole = behind | ((col == value) & whole)
            bound = (col <= value) | col.isNull() if down else col >= value
            if name == "timestamp" and "event_month" in df.columns:
                month = F.col("event_month")
                bound = bound & ((month <= month_key(value)) | month.isNull() if down else month >= month_key(value))
    return bound & whole


def cap(df: DataFrame, n: int = DEFAULT_ROWS, order: Sequence[Column] = ()) -> DataFrame:
    """At most ``n`` rows, between 1 and 10000, for ad-hoc queries: the first of ``order``, any rows without one."""
    if not 1 <= n <= MAX_ROWS:
        raise ValueError(f"row cap must be between 1 and {MAX_ROWS}")
    return (df.orderBy(*order) if order else df).limit(n)
