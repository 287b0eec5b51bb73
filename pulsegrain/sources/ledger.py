"""A record of what a job has taken in, so that running it again adds nothing.

A unit (a source file, a micro-batch) is noted as begun before its rows are appended, and as done afterwards. Units that are
done are left out from then on. Units that an interrupted run had begun are taken again, and the caller is told, as some
of their rows may be stored already. The record is a Parquet table; only one job may write it at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "unit string, done boolean"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(unit, done): one row for each unit and state, none where nothing was recorded."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def open_units(units: DataFrame, path: str) -> DataFrame:
    """The rows of ``units`` (with a column ``unit``) that are not done, and whether an earlier run had begun them."""
    known = read_ledger(units.sparkSession, path).groupBy("unit").agg(F.bool_or("done").alias("_done"))
    joined = units.join(known, "unit", "left").filter(~F.coalesce("_done", F.lit(False)))
    return joined.withColumn("begun", F.col("_done").isNotNull()).drop("_done")


def mark(units: DataFrame, path: str, done: bool) -> None:
    units.select("unit", F.lit(done).alias("done")).coalesce(1).write.mode("append").parquet(path)
