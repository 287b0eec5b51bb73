"""Joins of events and sessions with their dimensions.

No join carries a broadcast hint. Spark broadcasts a side only when its size, estimated or
measured at run time, is below ``spark.sql.autoBroadcastJoinThreshold``; above it the join is
sort-merge, and adaptive execution splits partitions made large by a hot key.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrain.operators.dedupe import one_per_key
from pulsegrain.operators.filters import active_rows


def resolve_project(events: DataFrame, api_keys: DataFrame, projects: DataFrame,
                    as_of: dt.datetime | Column, key: str = "api_key") -> DataFrame:
    """Give each event the project of its API key; events with no active, unexpired key drop out.

    Keys are stored as SHA-256; the key an event carries is hashed before the lookup. What the key permits comes
    along as ``permissions``, where keys have it.
    """
    own = [c for c in ("permissions",) if c in api_keys.columns]
    keys = (active_rows(api_keys, as_of).select("key_hash", "project_id", *own)
            .join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id"))
    # Key hashes are not unique: the smallest project decides, and an event stays one row.
    # (Maps have no order, their sorted entries do.)
    order = F.struct("project_id", "project_name", *(F.array_sort(F.map_entries(c)) for c in own))
    first = F.min_by(F.struct("project_id", "project_name", *own), order).alias("_project")
    keys = one_per_key(keys, "key_hash", first).select("key_hash", "_project.*")
    hashed = events.drop("project_id", *own).withColumn("key_hash", F.sha2(F.col(key), 256))
    return hashed.join(keys, "key_hash").drop("key_hash")


def with_user(events: DataFrame, users: DataFrame, user_key: str = "id", prefix: str = "user_") -> DataFrame:
    """Events with the attributes of their user (NULL when unknown), each prefixed (definition ours)."""
    attributes = users.select(F.col(user_key).alias("user_id"),
                              *[F.col(c).alias(prefix + c) for c in users.columns if c != user_key])
    return events.join(attributes, "user_id", "left")


def sessions_with_user(sessions: DataFrame, users: DataFrame, user_key: str = "id", prefix: str = "user_") -> DataFrame:
    """Sessions with the attributes of their user; sessions without a user drop out."""
    attributes = users.select(F.col(user_key).alias("user_id"),
                              *[F.col(c).alias(prefix + c) for c in users.columns if c != user_key])
    return sessions.join(attributes, "user_id", "inner")


def project_activity(projects: DataFrame, api_keys: DataFrame, dashboards: DataFrame, ai_queries: DataFrame) -> DataFrame:
    """Keys, dashboards and logged queries per project (definition ours).

    Each child is aggregated to one row per project before it is joined, so rows never multiply.
    """
    keys = api_keys.groupBy("project_id").agg(
        F.count("*").alias("api_keys"), F.count_if("is_active").alias("active_keys"))
    boards = dashboards.groupBy("project_id").agg(F.count("*").alias("dashboards"))
    log = ai_queries.groupBy("project_id").agg(
        F.count("*").alias("queries"), F.max("created_at").alias("last_query_at"))
    base = projects.select(F.col("id").alias("project_id"), "name")
    joined = base.join(keys, "project_id", "left").join(boards, "project_id", "left").join(log, "project_id", "left")
    return joined.fillna(0, ["api_keys", "active_keys", "dashboards", "queries"])
