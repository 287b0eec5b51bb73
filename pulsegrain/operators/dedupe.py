"""Removing repeated deliveries and superseded rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrain.functions.props import props_key

DELIVERY_KEY = ("user_id", "session_id", "event_name", "timestamp")


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by ``order``.

    Spark puts a per-task group limit below the shuffle, so a key with very many copies leaves
    each task as a single row.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def dedupe_events(df: DataFrame, order: str | None = "id") -> DataFrame:
    """Keep one event of each group equal in user, session, name, time and properties.

    Senders retry and may send twice on unload, without an id, so the content is the key.
    Properties are compared in key order, by the SHA-256 of their text: long ones are not shuffled and sorted a second
    time as a key. The lowest ``order`` value is kept.
    """
    tie = [F.col(order)] if order and order in df.columns else [F.lit(1)]
    keyed = df.withColumn("_props_key", F.unhex(F.sha2(props_key(), 256)))
    return first_per_key(keyed, [*DELIVERY_KEY, "_props_key"], tie).drop("_props_key")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the newest row per key; ``order`` should be a total order."""
    return first_per_key(df, list(keys), [F.col(c).desc_nulls_last() for c in order])


def one_per_key(df: DataFrame, key: str, *aggs: Column) -> DataFrame:
    """Aggregate a lookup to one row per key, so that a join with it can still be split.

    Adaptive execution divides the rows of a hot key among tasks only if both join inputs come
    straight from a shuffle. An aggregate on the join key would be joined without one. Grouping by
    one more column that follows from the key leaves the groups as they are and makes Spark
    shuffle the (small) result for the join.
    """
    keyed = df.withColumn("_follows", F.hash(key))
    grouped = keyed.groupBy(key, "_follows").agg(*aggs) if aggs else keyed.select(key, "_follows").distinct()
    return grouped.drop("_follows")
