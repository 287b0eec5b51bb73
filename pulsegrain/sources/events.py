"""The event table: Parquet, one folder per month, sorted by time, user and name."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrain.functions.periods import month_key
from pulsegrain.schemas import EVENTS, EVENTS_PARTITIONED
from pulsegrain.sources.store import folders

# Row groups carry a Bloom filter of their users, as large as these need, so that a look for few users skips the others.
BLOOM = {"parquet.bloom.filter.enabled#user_id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def read_events(spark: SparkSession, path: str, months: Iterable[str | None] | None = None) -> DataFrame:
    """Read the event table; ``months`` (yyyyMM; None: events without a time) prunes partitions before any file is opened."""
    events = spark.read.schema(EVENTS_PARTITIONED).parquet(path)
    if months is None:
        return events
    wanted = set(months)
    known = F.col("event_month").isin(sorted(wanted - {None}))
    return events.filter(known | F.col("event_month").isNull() if None in wanted else known)


def read_files(spark: SparkSession, path: str, names: Iterable[str]) -> DataFrame:
    """Some files of the event table, by their names below it."""
    root = path.rstrip("/")
    return spark.read.schema(EVENTS_PARTITIONED).option("basePath", root).parquet(*(f"{root}/{n}" for n in names))


def newest_instant(spark: SparkSession, path: str) -> dt.datetime | None:
    """The newest event time of the stored table, as an ``as_of`` for many queries; None if no event has a time.

    Month folders are listed, and read from the newest one back until one holds an event.
    """
    for month in sorted(folders(spark, path, "event_month"), reverse=True):
        newest = read_events(spark, path, [month]).agg(F.max("timestamp")).first()[0] if month.isdigit() else None
        if newest is not None:
            return newest
    return None


def write_by_user(df: DataFrame, table: str, path: str, buckets: int = 200) -> DataFrame:
    """Write a second copy of the events as a table bucketed and sorted by user, and return it.

    What groups by user (sessions, ordered funnels, retention, profiles) needs no shuffle of events there. All events of
    a user lie in one bucket: where one user may hold a large part of all events, use the table by month,
    whose partitions are split.
    """
    rows = conform(df).withColumn("event_month", month_key("timestamp"))
    (rows.repartition(buckets, "user_id").write.mode("overwrite").option("path", path)
     .bucketBy(buckets, "user_id").sortBy("user_id", "timestamp").saveAsTable(table))
    return df.sparkSession.table(table)


def conform(df: DataFrame) -> DataFrame:
    """Select the event columns in table order; absent ones become NULL."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in EVENTS.fields])


def write_events(df: DataFrame, path: str, mode: str = "append", dynamic: bool = False) -> None:
    """Write events by month.

    Rows are range-partitioned on (month, time, user), so that a large month, or one hot instant,
    is written by many tasks, each holding a narrow time slice: row-group statistics on
    ``timestamp`` then prune well. ``dynamic`` replaces only the months present in ``df``.
    """
    rows = conform(df).withColumn("event_month", month_key("timestamp"))
    writer = (rows.repartitionByRange("event_month", "timestamp", "user_id")
              .sortWithinPartitions("event_month", "timestamp", "user_id", "event_name")
              .write.mode("overwrite" if dynamic else mode).options(**BLOOM).partitionBy("event_month"))
    if dynamic:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def to_json_rows(df: DataFrame, name: str = "value") -> DataFrame:
    """Each row as one JSON object; NULL fields are kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def write_json_rows(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write one JSON object per line."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
