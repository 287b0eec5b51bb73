"""Registry of checked queries: each has a Spark form and, where SQL can say it, a SQL form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    covers: str
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def plain(df: DataFrame) -> DataFrame:
    """Plain column types, so that both engines print values alike: times and dates as text,
    whole numbers as bigint, arrays as text."""
    cols = []
    for f in df.schema.fields:
        kind, col = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind.startswith("timestamp"):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind == "date":
            col = col.cast("string")
        elif kind in ("int", "smallint", "tinyint"):
            col = col.cast("bigint")
        elif kind == "array<string>":
            col = F.array_join(col, "|")
        cols.append(col.alias(f.name))
    return df.select(*cols)


def check(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``covers`` lists the operators it exercises."""

    def register(fn: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(name, covers, lambda spark, sf_dir: plain(fn(spark, sf_dir)), sql)
        return fn

    return register


def load() -> dict[str, Entry]:
    """All entries; importing the check modules fills the registry."""
    from pulsegrain.plans import checks_events, checks_jobs, checks_metrics, checks_rollups, checks_series, checks_streams  # noqa: F401
    return ENTRIES
