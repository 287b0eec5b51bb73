"""Streaming ingest: validate, resolve the project, enrich, land; and compaction of what landed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from pulsegrain.functions.props import props_key
from pulsegrain.operators.dedupe import DELIVERY_KEY
from pulsegrain.operators.joins import resolve_project
from pulsegrain.operators.shaping import enrich
from pulsegrain.operators.validation import apply_defaults, judge_events, parse_time
from pulsegrain.schemas import EVENTS
from pulsegrain.sources.events import conform, write_events
from pulsegrain.sources.ingest import delivery_id, without_stored
from pulsegrain.sources.ledger import mark, open_units
from pulsegrain.sources.store import folders
from pulsegrain.streaming.batches import batch_instant, last_batches, note_batch, replace_batch, run_of


def stream_ingest(raw: DataFrame, api_keys: DataFrame, projects: DataFrame, landing: str, rejected: str,
                  checkpoint: str, as_of: dt.datetime | None = None, key: str = "api_key", **rules) -> DataStreamWriter:
    """Writer that lands valid events by run and micro-batch, and rejected ones beside them.

    ``raw`` carries the client fields and an API key. Validation is computed once per batch: the
    verdicts are written as they are evaluated, and both outputs are read back from that.
    An event without a time gets the instant of its batch, against which keys expire too; ``as_of`` fixes that
    instant, to process a recorded stream again. Each received event has its own id, also where contents are equal:
    repeated deliveries are the matter of ``stream_dedupe``.
    """
    instants, run = f"{checkpoint.rstrip('/')}/received", run_of(raw.sparkSession, checkpoint)

    def land(batch: DataFrame, batch_id: int) -> None:
        received = batch_instant(batch.sparkSession, instants, batch_id)
        now = as_of or received
        judged = judge_events(batch.withColumn("_position", F.monotonically_increasing_id()), **rules).persist()
        try:
            good = judged.filter(F.col("error").isNull()).drop("field", "error").withColumns({
                "properties": F.from_json("properties", "map<string,string>"), "timestamp": parse_time("timestamp")})
            known = resolve_project(apply_defaults(good, now), api_keys, projects, now, key)
            events = enrich(known, {}).withColumn("id", delivery_id(F.lit(run), F.lit(received), F.lit(batch_id), F.col("_position")))
            replace_batch(conform(events), landing, batch_id, run)
            replace_batch(judged.filter(F.col("error").isNotNull()).drop("_position"), rejected, batch_id, run)
            note_batch(batch.sparkSession, landing, run, batch_id)
        finally:
            judged.unpersist()

    return raw.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)


def compact_landing(spark: SparkSession, landing: str, table: str, ledger: str | None = None) -> int:
    """Append the landed batches that are new since the last call to the monthly event table; returns their number.

    Only their folders are read, while the stream goes on. The ledger (``<table>-landed`` unless given) knows the batches
    taken before. If a call was interrupted, the next one takes its batches again without the ids that are stored by now.
    Every landed event is kept, as its id is its own.
    """
    ledger = ledger or f"{table.rstrip('/')}-landed"
    found = [(f"{run}/{b}", f"{landing}/run={run}/batch_id={b}") for run, last in last_batches(spark, landing).items()
             for b in folders(spark, f"{landing}/run={run}", "batch_id") if int(b) <= last]
    if not found:
        return 0
    units = open_units(spark.createDataFrame(found, "unit string, path string"), ledger).collect()  # one row a batch
    if not units:
        return 0
    taken = spark.createDataFrame([(u.unit,) for u in units], "unit string").coalesce(1)
    mark(taken, ledger, done=False)
    events = spark.read.schema(EVENTS).parquet(*[u.path for u in units])
    if any(u.begun for u in units):
        events = without_stored(spark, events, table)
    write_events(events, table)
    mark(taken, ledger, done=True)
    return len(units)


def stream_dedupe(df: DataFrame, within: str = "1 hour") -> DataFrame:
    """Drop repeated deliveries seen within ``within`` of each other.

    State is kept per distinct event only until the watermark passes it.
    """
    return (df.withColumn("_props_key", props_key()).withWatermark("timestamp", within)
            .dropDuplicatesWithinWatermark([*DELIVERY_KEY, "_props_key"]).drop("_props_key"))
