"""From raw documents to token shards: each stage takes what its predecessor kept, written as Parquet and read again.

The last stage returns the index of the shards; all others return the columns of ``documents``. There is no SQL for
the whole: language identification, the random mix and the byte-pair tokens have none (``tests/llm`` holds
the stages against brute force).
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrain.llm import decontaminate, language_id, mixing, near_dup, training_order
from pulsegrain.llm.common import crc_mod, recorded, table
from pulsegrain.session import work_dir
from pulsegrain.sources.store import remove

_left: list[str] = []  # folders that the result of the stage before is read from, until that is written


def _stage(made):
    """Remove what the stage before left, whose result is written by now, and note what this one leaves."""

    @wraps(made)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            remove(spark, _left.pop())
        with recorded() as folders:
            try:
                return made(spark, docs, sf_dir)
            finally:
                _left.extend(folders)

    return run_stage


@_stage
def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter go."""
    model = language_id.learn(docs.where(F.coalesce(crc_mod(F.col("doc_id"), 4) != 2, F.lit(False))))
    return language_id.keep_identified(docs, model)


@_stage
def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity of 0.8 or more)."""
    return near_dup.drop_near_duplicates(docs, near_dup.Settings(words=5, percent=80))


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return mixing.mix(docs)


@_stage
def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Binary shards of token ids in training order; returns their index."""
    return training_order.materialise(docs, work_dir(spark, "shards"))


STAGES = [
    ("language_id", identified),
    ("near_duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("source_mix", mixed),
    ("token_shards", token_shards),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_dir(spark, f"pipeline-{name}")
        kept = stage(spark, docs, sf_dir)
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return docs
