"""Rollups kept up to date by micro-batches, and session windows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from pulsegrain.functions.periods import month_key
from pulsegrain.operators.metrics import PAGE_VIEW
from pulsegrain.operators.rollups import (
    merge_rollup, merge_sessions, rollup_partial, rollup_sessions_partial, rollup_specs)
from pulsegrain.schemas import EVENTS
from pulsegrain.sources.store import folders, pointed, publish, remove
from pulsegrain.streaming.batches import last_batches, note_batch, replace_batch, run_of
from pulsegrain.streaming.sources import WATERMARK

SESSIONS = "sessions"
NO_MONTH = "none"  # rows without a time


def partial_of(events: DataFrame, name: str) -> DataFrame:
    return rollup_sessions_partial(events) if name == SESSIONS else rollup_partial(events, name)


def merged(partials: DataFrame, name: str) -> DataFrame:
    rows = merge_sessions(partials) if name == SESSIONS else merge_rollup(partials, list(rollup_specs()[name].keys))
    return rows.select(partials.columns)


def _month(name: str) -> Column:
    times = {SESSIONS: "session_start", "hourly": "hour", "minutes": "minute"}
    return F.coalesce(month_key(times.get(name, "date")), F.lit(NO_MONTH))


def store_partial(events: DataFrame, name: str, path: str, batch_id: int, run: str) -> None:
    """Store the partial rows of one batch by month; a replayed batch replaces its own rows."""
    rows = partial_of(events, name).withColumn("month", _month(name))
    replace_batch(rows, f"{path}/live", batch_id, run, ["month"])
    note_batch(events.sparkSession, path, run, batch_id)


def stream_rollup(events: DataFrame, name: str, path: str, checkpoint: str) -> DataStreamWriter:
    """Writer storing each micro-batch's partial rows. Rows are merged when read, and by ``compact_rollup`` meanwhile."""
    run = run_of(events.sparkSession, checkpoint)
    return (events.writeStream.foreachBatch(lambda batch, batch_id: store_partial(batch, name, path, batch_id, run))
            .option("checkpointLocation", checkpoint))


def _state(spark: SparkSession, path: str) -> dict:
    """What was compacted: the generation of each month, and by run the last batch that it holds."""
    return pointed(spark, f"{path}/state") or {"generation": 0, "months": {}, "upto": {}}


def _live(spark: SparkSession, path: str, state: dict, last: dict[str, int], month: str) -> dict[str, list[int]]:
    """Batches of a month, by run, up to the ``last`` complete ones, that are not compacted yet."""
    out = {}
    for run in folders(spark, f"{path}/live/month={month}", "run"):
        upto = state["upto"].get(run, -1)
        found = [b for b in map(int, folders(spark, f"{path}/live/month={month}/run={run}", "batch_id")) if upto < b <= last.get(run, -1)]
        if found:
            out[run] = found
    return out


def _partials(spark: SparkSession, path: str, state: dict, last: dict[str, int], months: Iterable[str], schema: StructType) -> DataFrame:
    """Compacted and live partials of the months; no other folder is listed."""
    parts = []
    for month in months:
        if month in state["months"]:
            parts.append(f"{path}/generation={state['months'][month]}/month={month}")
        parts += [f"{path}/live/month={month}/run={run}/batch_id={b}" for run, found in _live(spark, path, state, last, month).items() for b in found]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def _known_months(spark: SparkSession, path: str, state: dict) -> set[str]:
    return {*state["months"], *folders(spark, f"{path}/live", "month")}


def partial_schema(spark: SparkSession, name: str) -> StructType:
    return partial_of(spark.createDataFrame([], EVENTS), name).schema


def read_rollup(spark: SparkSession, path: str, name: str, months: Iterable[str] | None = None) -> DataFrame:
    """The rollup at its own grain, all complete batches merged; with ``months`` (yyyyMM), only these are looked at.

    A read that began keeps finding its files while batches arrive and while one compaction runs. Sessions are put
    under the month of their start, and are looked for in the months beside it too.
    """
    last, state = last_batches(spark, path), _state(spark, path)
    known = _known_months(spark, path, state)
    wanted = known if months is None else set(months)
    listed = known & (_with_neighbours(wanted) if name == SESSIONS and months is not None else wanted)
    rows = merged(_partials(spark, path, state, last, sorted(listed), partial_schema(spark, name)), name)
    return rows if months is None else rows.filter(_month(name).isin(sorted(wanted)))


def _with_neighbours(months: set[str]) -> set[str]:
    out = set(months)
    for month in months - {NO_MONTH}:
        n = int(month[:4]) * 12 + int(month[4:]) - 1
        out |= {f"{m // 12:04d}{m % 12 + 1:02d}" for m in (n - 1, n + 1)}
    return out


def compact_rollup(spark: SparkSession, path: str, name: str) -> int:
    """Merge the complete batches into one row a key, while the stream goes on; returns the new generation.

    Months with new batches are written to a folder of their own; the state, replaced in one step at the end, then names
    it and the batches it holds. An interrupted call leaves the state, and so all results, as they were. Folders that
    the state before this one did not need any more are removed; the last ones are left for readers that began before.
    Only one compaction may run at a time.
    """
    last, before = last_batches(spark, path), _state(spark, path)
    number = before["generation"] + 1
    runs, touched = {}, []
    for month in sorted(_known_months(spark, path, before)):
        found = _live(spark, path, before, last, month)
        if found:
            touched.append(month)
            for run, batches in found.items():
                runs[run] = max(runs.get(run, -1), *batches)
    if not touched:
        return before["generation"]
    schema = partial_schema(spark, name)
    for month in touched:
        rows = merged(_partials(spark, path, before, last, [month], schema), name)
        rows.write.mode("overwrite").parquet(f"{path}/generation={number}/month={month}")
    after = {"generation": number, "months": {**before["months"], **dict.fromkeys(touched, number)},
             "upto": {**before["upto"], **runs}, "previous": before["months"]}
    publish(spark, f"{path}/state", after)
    for month, generation in before.get("previous", {}).items():
        if before["months"].get(month) != generation:
            remove(spark, f"{path}/generation={generation}/month={month}")
    for month in folders(spark, f"{path}/live", "month"):
        for run, upto in before["upto"].items():
            for b in folders(spark, f"{path}/live/month={month}/run={run}", "batch_id"):
                if int(b) <= upto:
                    remove(spark, f"{path}/live/month={month}/run={run}/batch_id={b}")
    return number


def stream_sessions(df: DataFrame, gap: str = "30 minutes", watermark: str | None = WATERMARK) -> DataFrame:
    """Sessions as windows that close after ``gap`` without events; definition ours.

    ``watermark=None`` gives the batch form. A session's end here is its last event.
    """
    rows = df.withWatermark("timestamp", watermark) if watermark else df
    return (rows.groupBy("user_id", F.session_window("timestamp", gap).alias("_w"))
            .agg(F.min("timestamp").alias("session_start"), F.max("timestamp").alias("session_end"),
                 F.count("*").alias("events_count"), F.count_if(F.col("event_name") == PAGE_VIEW).alias("page_views"))
            .drop("_w"))
