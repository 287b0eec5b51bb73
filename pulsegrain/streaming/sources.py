"""Streaming sources, micro-batch triggers, and the watermark policy: what is late is counted and kept."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener
from pyspark.sql.types import StructType

from pulsegrain.schemas import EVENTS, RAW_EVENT
from pulsegrain.sources.ingest import parse_events, unify_spelling
from pulsegrain.sources.store import folders, pointed, publish
from pulsegrain.streaming.batches import replace_batch, run_of

# How late an event may be before it is dropped from windowed results (policy is ours).
WATERMARK = "10 minutes"


def stream_raw(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Client events arriving as JSON-lines files."""
    return unify_spelling(_files(spark, "json", path, RAW_EVENT, max_files))


def stream_events(spark: SparkSession, path: str, max_files: int | None = None,
                  schema: StructType = EVENTS) -> DataFrame:
    """Canonical events arriving as Parquet files."""
    return _files(spark, "parquet", path, schema, max_files)


def stream_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Client events from a Kafka topic, one JSON event per message.

    Needs the Kafka connector on the class path; not exercised by the tests here.
    """
    messages = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return parse_events(messages.selectExpr("cast(value AS string) AS value"))


def _files(spark: SparkSession, kind: str, path: str, schema: StructType, max_files: int | None) -> DataFrame:
    reader = spark.readStream.format(kind).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def micro_batch(seconds: int = 10, available_now: bool = False) -> dict[str, object]:
    """Trigger options: a batch every few seconds, or all waiting data and stop."""
    return {"availableNow": True} if available_now else {"processingTime": f"{seconds} seconds"}


class LateRows(StreamingQueryListener):
    """Adds up, by query, the rows that stateful operators dropped behind the watermark, over all batches and restarts.

    Register it with ``spark.streams.addListener``. The totals are kept in the pointer ``path``, with the last batch
    counted, so a listener that is started again goes on from there.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.totals: dict[str, dict[str, int]] = pointed(spark, path) or {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.count(str(event.progress.id), event.progress.batchId, [op.numRowsDroppedByWatermark for op in event.progress.stateOperators])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def count(self, query: str, batch: int, dropped: list[int]) -> None:
        """Add one batch's report; one that was counted before adds nothing."""
        known = self.totals.setdefault(query, {"batch": -1, "dropped": 0})
        if batch > known["batch"]:
            known |= {"batch": batch, "dropped": known["dropped"] + sum(dropped)}
            publish(self.spark, self.path, self.totals)

    def dropped(self, query_id: str) -> int:
        """Rows dropped by a query so far, once the reports on their way have arrived."""
        self.spark._jsc.sc().listenerBus().waitUntilEmpty()
        return self.totals.get(str(query_id), {"dropped": 0})["dropped"]


def split_late(df: DataFrame, watermark: dt.datetime | None) -> tuple[DataFrame, DataFrame]:
    """(in time, late): rows at or behind the watermark are late, as for Spark's own operators; without a time, in time."""
    if watermark is None:
        return df, df.filter(F.lit(False))
    late = F.coalesce(F.col("timestamp") <= F.lit(watermark).cast("timestamp"), F.lit(False))
    return df.filter(~late), df.filter(late)


def stream_late(df: DataFrame, path: str, checkpoint: str, delay: dt.timedelta = dt.timedelta(minutes=10), behind: int = 0) -> DataStreamWriter:
    """Writer that stores the rows which a watermark of ``delay`` calls late, by run and batch (``read_late``).

    The watermark of a batch is the newest time of the batches before it, less the delay. Spark's operators judge by the
    watermark that the batch before had: while batches of data follow each other without a pause that is one further
    back (``behind=1``), else, after the batch without data that Spark then puts in between, it is the same (0). The newest
    times are kept beside the rows, so a batch that is replayed finds the one it had.
    """
    run = run_of(df.sparkSession, checkpoint)
    pointer = f"{path.rstrip('/')}-watermarks/{run}"

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = {int(b): at for b, at in (pointed(spark, pointer) or {}).items()}  # microseconds, by batch
        at = newest.get(batch_id - 1 - behind)
        mark = None if at is None else dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=at) - delay
        replace_batch(split_late(batch, mark)[1], path, batch_id, run)
        own = batch.agg(F.max(F.unix_micros("timestamp")).alias("at")).first()["at"]
        newest[batch_id] = max((t for t in (own, newest.get(batch_id - 1)) if t is not None), default=None)
        publish(spark, pointer, {b: t for b, t in newest.items() if b > batch_id - 3 - behind})

    return df.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def read_late(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The late rows stored so far, without the columns that tell their batch."""
    stored = [f"{path}/run={run}" for run in folders(spark, path, "run")]
    return spark.read.schema(schema).parquet(*stored) if stored else spark.createDataFrame([], schema)
