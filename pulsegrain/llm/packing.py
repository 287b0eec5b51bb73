"""Best-fit packing of documents into token sequences of a fixed capacity, in rounds over a tree of tasks.

1. ``cut`` makes token ids of each text and an end mark. What is longer than the capacity is cut into full pieces, the
   rest being its first piece. The pieces are written with their ids.
2. ``pack`` deals any rows with a size to tasks of ``per_task`` rows. A task packs its rows best-fit, the largest first,
   so the fullest sequence that has room takes the next row. Nearly full sequences are done.
3. The others are items of the next round, each as large as it is full, dealt to as many fewer tasks, and so on until
   one task sees all that are left, or a round leaves nine in ten. At last, offsets are added up along the rounds.

Memory is that of ``per_task`` rows in a task; only row counts reach the driver. Rows that need no packing, and
sequences found full, never travel again.

Ids are those of the ``tokenizers`` library with the same file. ``tiktoken`` makes them here, several times faster, from
the vocabulary in that file; the tests hold the two against each other on every code point.

Defined cases: NULL and empty texts are one end mark. Ids may be NULL or repeat; rows are told apart by a key of their
own. Other columns of the documents are not read, whatever their names. An empty table gives no piece.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsegrain.llm.common import fresh, staged

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: how text is split before the merges of this vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY, END, PER_TASK = 1024, 2, 1 << 15
HELD = 1 << 20  # ids that a task holds before it passes them on


def load_vocabulary(path: str = VOCABULARY) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks of the byte strings, and the special tokens, of a byte-level file of the tokenizers library."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    # Such files write a byte as its own character where that is printable, else as one from 256 on.
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    return ranks, special


def cut(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, doc_id, piece, start, length, ids), written: ids as little-endian uint32; ``key`` tells pieces apart."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(path))  # a vocabulary, whatever the documents
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import TaskContext
        ranks, special = shared.value
        coder = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        key = TaskContext.get().partitionId() << 33

        def made(owners: pa.Array, of: list[int], piece: list[int], start: list[int], blobs: list[bytes]) -> pa.RecordBatch:
            nonlocal key
            keys = pa.array(np.arange(key, key + len(of)))
            key += len(of)
            length = pa.array([len(b) // 4 for b in blobs], pa.int32())
            return pa.RecordBatch.from_arrays([keys, owners.take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                                               length, pa.array(blobs, pa.binary())], names=["key", "doc_id", "piece", "start", "length", "ids"])

        for batch in batches:
            owners, of, piece, start, blobs, held = batch.column("doc_id"), [], [], [], [], 0
            for row, value in enumerate(batch.column("text")):
                stream = np.append(coder.encode_to_numpy(value.as_py() or "", allowed_special="all"), end).astype("<u4")
                first = len(stream) % capacity or capacity
                at = [0, *range(first, len(stream) + 1, capacity)]
                for n, (a, b) in enumerate(zip(at, at[1:])):
                    of.append(row)
                    piece.append(n)
                    start.append(a)
                    blobs.append(stream[a:b].tobytes())
                held += len(stream)
                if held >= HELD:
                    yield made(owners, of, piece, start, blobs)
                    of, piece, start, blobs, held = [], [], [], [], 0
            if of:
                yield made(owners, of, piece, start, blobs)

    pieces = rows.mapInArrow(encode, f"key bigint, doc_id {kind}, piece int, start bigint, length int, ids binary")
    return staged(spark, pieces, "pieces", compression="zstd")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each item, its place there, and how full each bin is; the largest items first."""
    where, place, fills = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int32), []
    with_room = [[] for _ in range(capacity + 1)]  # bins by the room they have
    rooms = 0  # bit r is set if a bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, chosen = capacity, len(fills)
            fills.append(0)
        where[i], place[i] = chosen, capacity - room
        fills[chosen] = capacity - room + size
        if room > size:
            with_room[room - size].append(chosen)
            rooms |= 1 << (room - size)
    return where, place, np.array(fills, np.int32)


def _round(items: DataFrame, size: str, number: int, tasks: int, per_task: int, capacity: int, names: list[str]) -> DataFrame:
    """``items`` with the bin, the place in it and its fill (``names``), packed within each of ``tasks`` tasks; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        base, held, rows = (number << 56) + (TaskContext.get().partitionId() << 34), [], 0

        def packed(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal base
            sizes = table.column(size).to_numpy()
            if len(sizes) and not (0 <= sizes.min() and sizes.max() <= capacity):
                raise ValueError(f"sizes must be between 0 and {capacity}")
            where, place, fills = best_fit(sizes, capacity)
            for name, values in zip(names, (base + where, place, fills[where] if len(fills) else place)):
                table = table.append_column(name, pa.array(values))
            base += len(fills)
            yield from table.to_batches(10_000)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 2 * per_task:  # no task holds more, however the rows were dealt
                yield from packed(pa.Table.from_batches(held))
                held, rows = [], 0
        if held:
            yield from packed(pa.Table.from_batches(held))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema), f"`{names[0]}` bigint", *(f"`{n}` int" for n in names[1:])])
    return staged(items.sparkSession, items.repartition(tasks).mapInArrow(run, schema), "packed")


def pack(items: DataFrame, size: str = "length", capacity: int = CAPACITY, per_task: int = PER_TASK) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``: no sequence holds more than ``capacity``, and none has a gap.

    ``size`` is an int column of 0 to ``capacity``; another value is an error.
    """
    bin_, place, fill = fresh(items, "_bin"), fresh(items, "_place"), fresh(items, "_fill")
    nearly = capacity - capacity // 64
    tasks = max(1, -(-items.count() // per_task))
    first = _round(items, size, 0, tasks, per_task, capacity, [bin_, place, fill])
    # A bin stands in the row of its first item; where that has size 0, others share place 0, so one of them is taken.
    left = first.where((F.col(place) == 0) & (F.col(fill) < nearly)).select(F.col(bin_).alias("item"), F.col(fill).alias("size")).distinct()
    rounds, waiting = [], None
    while tasks > 1:
        n = left.count()
        if n < 2 or (waiting and 10 * n > 9 * waiting):
            break
        tasks, waiting = max(1, -(-n // per_task)), n
        rounds.append(_round(left, "size", len(rounds) + 1, tasks, per_task, capacity, ["bin", "place", "fill"]))
        left = rounds[-1].where((F.col("place") == 0) & (F.col("fill") < nearly)).select(F.col("bin").alias("item"), F.col("fill").alias("size")).distinct()
    moved = None
    for step in reversed(rounds):
        step = step.select("item", "bin", "place")
        if moved is not None:
            later = moved.select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("place").alias("by"))
            step = step.join(later, "bin", "left").select("item", F.coalesce("to", "bin").alias("bin"), (F.col("place") + F.coalesce("by", F.lit(0))).alias("place"))
        moved = step
    out = [c for c in items.columns if c.lower() not in ("sequence_id", "offset")]
    if moved is None:
        return first.select(*(F.col(f"`{c}`") for c in out), F.col(bin_).alias("sequence_id"), F.col(place).cast("bigint").alias("offset"))
    to, by = fresh(first, "_to"), fresh(first, "_by")
    moved = moved.select(F.col("item").alias(bin_), F.col("bin").alias(to), F.col("place").alias(by))
    return first.join(moved, bin_, "left").select(
        *(F.col(f"`{c}`") for c in out), F.coalesce(to, bin_).alias("sequence_id"), (F.col(place) + F.coalesce(by, F.lit(0))).cast("bigint").alias("offset"))
