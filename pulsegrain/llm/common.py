"""Small helpers shared by the operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrain.session import work_dir
from pulsegrain.sources.store import remove

SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_open: list[list[str]] = []  # folders staged inside each open block, the innermost block last


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that ``staged`` makes inside the block, for the caller to remove when their readers are done."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.pop()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Folders staged inside the block are removed at its end, also after an error, but for ``lasting`` ones."""
    with recorded() as made:
        try:
            yield
        finally:
            for path in made:
                remove(spark, path)


# What a task holds at a time of rows with whole texts: batches read, and batches on their way to Python and back.
BATCHES = {
    "spark.sql.parquet.columnarReaderBatchSize": "1024",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside the block move rows in small batches; the session's own settings are back at its end."""
    before = {key: spark.conf.get(key) for key in BATCHES}
    try:
        for key, value in BATCHES.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def staged(spark: SparkSession, df: DataFrame, name: str, lasting: bool = False, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs neither recompute it nor lose it
    with an executor. ``lasting`` tables outlive the innermost block they are made in."""
    path = work_dir(spark, name)
    if len(_open) > lasting:
        _open[-1 - lasting].append(path)
    with small_batches(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcast ``value``; the result gives it inside tasks. Classes of this subpackage travel with it, as workers need not
    have the library."""
    holder, opened = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def get() -> Any:
        if not opened:
            opened.append(pickle.loads(holder.value))
        return opened[0]

    return get


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_mod(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(divisor)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
