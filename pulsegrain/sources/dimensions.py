"""Dimension tables: scans, insert-if-absent, and key lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pulsegrain.operators.dedupe import one_per_key
from pulsegrain.schemas import DIMENSIONS


def read_dim(spark: SparkSession, name: str, path: str | None = None,
             jdbc: dict[str, str] | None = None) -> DataFrame:
    """Read a dimension table from Parquet files or over JDBC.

    Large tables should pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` in ``jdbc``, or a single task reads the whole table.
    """
    schema = DIMENSIONS[name]
    if jdbc is not None:
        return spark.read.format("jdbc").options(dbtable=name, **jdbc).load().select(schema.names)
    if path is None:
        raise ValueError("give a path or JDBC options")
    return spark.read.schema(schema).parquet(path)


def insert_absent(target: DataFrame, new: DataFrame, key: str, order: str | Column | None = None) -> DataFrame:
    """``target`` plus the rows of ``new`` whose key it lacks (insert, on conflict do nothing).

    Among new rows sharing a key the first by ``order`` (default: by all comparable columns) wins.
    As with a unique index, NULL keys never conflict and are all inserted.
    """
    if order is None:
        comparable = [f.name for f in new.schema.fields if not f.dataType.simpleString().startswith("map")]
        order_by = [F.col(c) for c in comparable]
    else:
        order_by = [F.col(order) if isinstance(order, str) else order]
    keyed = new.filter(F.col(key).isNotNull())
    first = (keyed.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order_by)))
             .filter("_rank = 1").drop("_rank"))
    absent = first.join(target.select(key), key, "left_anti").select(new.columns)
    return (target.unionByName(absent, allowMissingColumns=True)
            .unionByName(new.filter(F.col(key).isNull()), allowMissingColumns=True))


def resolve_fk(df: DataFrame, dim: DataFrame, on: str, value: str, alias: str) -> DataFrame:
    """Add ``alias``: the ``value`` of the one ``dim`` row whose ``on`` equals ours, else NULL.

    Should several rows share the key, the smallest value is taken, so no row is multiplied.
    No broadcast hint: Spark broadcasts the lookup when its size allows, and joins otherwise.
    """
    return df.join(one_per_key(dim, on, F.min(value).alias(alias)), on, "left")
