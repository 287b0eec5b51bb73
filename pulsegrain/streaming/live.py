"""Live feeds and rolling metrics."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from pulsegrain.operators.filters import apply_filters, for_project
from pulsegrain.operators.metrics import PAGE_VIEW, approx_users
from pulsegrain.operators.paging import MAX_RECENT, recent_per_project
from pulsegrain.sources.store import folders, pointed, publish, remove
from pulsegrain.streaming.batches import batch_instant, run_of
from pulsegrain.streaming.sources import WATERMARK

# Allowed requests per minute.
RATE_LIMITS = {"events": 1000, "api": 100, "queries": 10}


def live_feed(df: DataFrame, project_id: str, filters: Mapping[str, str] | None = None) -> DataFrame:
    """Accepted events of one project, optionally filtered; stateless."""
    return apply_filters(for_project(df, project_id), filters or {})


def stream_realtime(df: DataFrame, width: str = "5 minutes", slide: str = "30 seconds",
                    watermark: str = WATERMARK, k: int = 5) -> DataFrame:
    """Events, users, sessions and top names per project over a sliding window.

    Distinct counts and top names are bounded sketches: streaming has no exact distinct count, and
    a window's state must not grow with its rows. Each event enters ``width / slide`` windows.
    """
    return (df.withWatermark("timestamp", watermark)
            .groupBy("project_id", F.window("timestamp", width, slide).alias("_w"))
            .agg(F.count("*").alias("events"), approx_users("user_id").alias("users"),
                 approx_users("session_id").alias("sessions"),
                 F.call_function("approx_top_k", F.col("event_name"), F.lit(k)).alias("_top"))
            .select("project_id", F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
                    "events", "users", "sessions", F.transform("_top", lambda e: e["item"]).alias("top_events")))


def metric_updates(df: DataFrame, width: str = "1 minute", watermark: str = WATERMARK) -> DataFrame:
    """Metric values per project and minute in long form: (project_id, metric, value, timestamp)."""
    per_window = (df.withWatermark("timestamp", watermark)
                  .groupBy("project_id", F.window("timestamp", width).alias("_w"))
                  .agg(F.count("*").alias("events"), F.count_if(F.col("event_name") == PAGE_VIEW).alias("page_views"),
                       approx_users("user_id").alias("active_users")))
    return per_window.select(
        "project_id", F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("events", "page_views", "active_users")])),
        F.col("_w.end").alias("timestamp"))


def rate_audit(df: DataFrame, key: str, limit: int = RATE_LIMITS["events"], width: str = "1 minute",
               watermark: str | None = None) -> DataFrame:
    """Senders above ``limit`` per window. Works on batches and, with a watermark, on streams."""
    rows = df.withWatermark("timestamp", watermark) if watermark else df
    return (rows.groupBy(key, F.window("timestamp", width).alias("_w")).agg(F.count("*").alias("requests"))
            .filter(F.col("requests") > limit)
            .select(key, F.col("_w.start").alias("window_start"), "requests"))


def stream_recent(df: DataFrame, path: str, checkpoint: str, n: int = MAX_RECENT,
                  keep: dt.timedelta = dt.timedelta(hours=1), now: Callable[[int], dt.datetime] | None = None) -> DataStreamWriter:
    """Writer keeping every project's newest ``n`` events, and when its list ends: ``keep`` after the last push.

    Each batch writes a generation of its own and then names it in a pointer that is replaced in one step, so a reader
    never sees a part. A batch that is replayed starts from the generation before it again. Lists that have ended are left
    out of the next generation, and the reader leaves them out from their end on, also while nothing arrives. A
    generation holds at most ``n`` rows a project; older ones are removed, but for the last two, which a
    reader may still hold. ``now`` gives the instant of a batch, to process a recorded stream again.
    """
    instants, run = f"{checkpoint.rstrip('/')}/received", run_of(df.sparkSession, checkpoint)

    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = now(batch_id) if now else batch_instant(spark, instants, batch_id)
        state = pointed(spark, _pointer(path)) or {"name": None, "before": None}
        name = f"{run}-{batch_id}"
        before = state["before"] if state["name"] == name else state["name"]
        rows = batch.withColumn("expires_at", F.lit(at + keep).cast("timestamp"))
        if before is not None:
            stored = spark.read.schema(rows.schema).parquet(f"{path}/{before}").filter(F.col("expires_at") > F.lit(at))
            rows = rows.unionByName(stored)
        recent = recent_per_project(rows, n)
        ends = rows.groupBy("project_id").agg(F.max("expires_at").alias("expires_at"))  # a push renews the whole list
        recent.drop("expires_at").join(ends, "project_id").select(rows.columns).write.mode("overwrite").parquet(f"{path}/{name}")
        publish(spark, _pointer(path), {"name": name, "before": before})
        for old in folders(spark, path, ""):
            if old not in (name, before, state["before"]):
                remove(spark, f"{path}/{old}")

    return df.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)


def _pointer(path: str) -> str:
    return f"{path.rstrip('/')}-newest"


def read_recent(spark: SparkSession, path: str, at: dt.datetime | None = None) -> DataFrame:
    """The lists that have not ended at an instant (now, unless given); an error before the first batch."""
    state = pointed(spark, _pointer(path))
    if state is None:
        raise ValueError(f"nothing was stored in {path} yet")
    when = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    return spark.read.parquet(f"{path}/{state['name']}").filter(F.col("expires_at") > when).drop("expires_at")
