"""Exact de-duplication against a persistent index of text digests.

The index is a Parquet table bucketed and sorted by digest, so that new data meet it in a sort-merge
anti-join that does not move the index. What is new is appended, one row per digest; a repeated append after a
failure finds its rows already there and adds nothing. One writer at a time.

Defined cases: a NULL text is the empty text. Rows without an id count as copies, and stay only where no copy
has an id. Rows with equal id and equal text are one document and stay together. Texts of any length are
digested whole. An empty batch leaves the index as it is. Other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrain.llm.common import staged
from pulsegrain.sources.store import files, pointed, publish


class DigestIndex:
    """The index kept under ``path``; opening it again, also in another session, finds what is there.

    ``buckets``, about one for each 128 MB of index, is for an index that is made here. It is kept beside the index, and an
    index that exists goes on with its own, whatever is asked for.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int = 64):
        self.spark = spark
        layout = f"{path.rstrip('/')}-layout"
        known = pointed(spark, layout)
        if known is None:
            if files(spark, path):
                raise ValueError(f"{path} holds data, but {layout}, which tells its buckets, is missing")
            publish(spark, layout, {"buckets": buckets})
            known = pointed(spark, layout)
        self.buckets = buckets = known["buckets"]
        self.name = f"digest_index_{hashlib.sha256(path.encode()).hexdigest()[:16]}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id {id_type}) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append_new(self, groups: DataFrame) -> None:
        """Add the rows (digest, keep_id) whose digest the index lacks; digests are unique in ``groups``."""
        new = groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        new.select("digest", "keep_id").repartition(self.buckets, "digest").write.insertInto(self.name)

    def admit(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Take in a batch and tell the fate of each row.

        Returns (doc_id, digest, keep_id, group_size, kept): ``keep_id`` is the id the index holds for the text
        (of an earlier batch, or the largest of this one), ``group_size`` counts the batch.
        """
        rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"),
                           F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)).alias("digest"))
        # Groups are reduced in the map tasks, so a text that fills a third of the table is one row per task.
        groups = staged(self.spark, rows.groupBy("digest").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
        self.append_new(groups)
        fates = staged(self.spark, groups.drop("keep_id").join(self.read().hint("merge"), "digest"), "digest-fates")
        # Both sides come from storage and are shuffled for the join alone, so adaptive execution can split hot digests.
        return rows.join(fates, "digest").select(
            "doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))
