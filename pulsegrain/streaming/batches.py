"""What a writer keeps about its micro-batches, so that a replayed one does as it did before."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrain.sources.store import files, pointed, publish


def replace_batch(df: DataFrame, path: str, batch_id: int, run: str, by: Sequence[str] = ()) -> None:
    """Write the rows of one micro-batch under its own partition, replacing an earlier attempt.

    A batch replayed after a failure overwrites what it wrote before, so nothing counts twice. Batches are told apart
    by their number and by the ``run``, as numbers start anew with each checkpoint. ``by`` names further partition columns, put first.
    """
    (df.withColumns({"run": F.lit(run), "batch_id": F.lit(batch_id)}).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*by, "run", "batch_id").parquet(path))


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The name of all batches that one checkpoint counts: made up once, and kept beside the offsets."""
    place = f"{checkpoint.rstrip('/')}/run-name"
    known = pointed(spark, place)
    if known is None:
        publish(spark, place, {"run": uuid.uuid4().hex})
        known = pointed(spark, place)
    return known["run"]


def note_batch(spark: SparkSession, path: str, run: str, batch_id: int) -> None:
    """Note that all rows of a batch, and so of those before it, are in place."""
    publish(spark, f"{path.rstrip('/')}-runs/{run}", {"last": batch_id})


def last_batches(spark: SparkSession, path: str) -> dict[str, int]:
    """By run, the newest batch whose rows, and those of all batches before it, are in place."""
    place = f"{path.rstrip('/')}-runs"
    return {run: pointed(spark, f"{place}/{run}")["last"] for run in files(spark, place) if "." not in run}


def batch_instant(spark: SparkSession, path: str, batch_id: int) -> dt.datetime:
    """The instant, in whole milliseconds, at which a micro-batch was first received. It is stored, so a replay of the batch finds the same."""
    folder = f"{path}/batch={batch_id}"
    try:
        known = spark.read.schema("at timestamp").parquet(folder).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        known = None
    if known is None:  # no folder, or one whose write was cut short
        spark.sql("SELECT date_trunc('millisecond', current_timestamp()) AS at").write.mode("overwrite").parquet(folder)
        known = spark.read.schema("at timestamp").parquet(folder).first()
    return known.at
