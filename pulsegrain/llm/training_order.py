"""Token sequences in training order, as binary shards of fixed-stride records.

1. ``tokenise``: each document becomes token ids and an end mark; a task puts its documents one behind the other and cuts
   them into sequences of ``length`` ids, of which only its last one is filled up. They are written to the shared
   folder with the task and their number there.
2. With the sequence counts of the tasks (one row a task), every sequence has a number below the total ``n``. A keyed
   Feistel permutation over the next even power of two, walked until it falls below ``n`` again, gives its global slot.
3. Slots are dealt by range: shard ``k`` holds the slots from ``k * per_shard``. Map tasks bundle what goes to one shard
   and compress it; the shard's task puts each record at its place and writes the file. A file is written under
   a name of its own and moved, so a repeated task replaces it by the same bytes.

A record is ``length`` little-endian uint16 ids, filled up with the end mark; its place in its file follows from the
slot, so reading can resume anywhere (``read_from``). Shard files need a store that pyarrow can write (local or mounted,
S3, GCS, HDFS). Slots depend on the key and on how the input is split into tasks.

Defined cases: NULL and empty texts are one end mark. Ids may be NULL or repeat. Long texts reach over many
sequences. An empty table gives no shard and an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrain.llm.common import staged

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how text is split before the merges of this vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


BUNDLED = 1 << 16  # records that a map task holds at a time


@dataclass(frozen=True)
class Layout:
    length: int = 256  # ids in a record
    per_shard: int = 1 << 14  # records in a shard file
    key: str = "order"
    end: int = 50256

    @property
    def stride(self) -> int:
        return 2 * self.length


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def permute(numbers: np.ndarray, n: int, key: str, rounds: int = 6) -> np.ndarray:
    """Slots of the numbers below ``n``: a bijection of 0 .. n-1."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{i}".encode()).digest()[:8], "big")) for i in range(rounds)]
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while walking.size:
        left, right = out[walking] >> shift, out[walking] & mask
        for k in keys:
            mixed = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((mixed >> np.uint64(29)) & mask)
        out[walking] = (left << shift) | right
        walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


def tokenise(docs: DataFrame, layout: Layout, ranks: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(task, number, doc_ids, n_tokens, ids), written: one row a sequence, numbered within its task."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary, whatever the documents
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import TaskContext
        coder = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=shared.value, special_tokens={})
        task, done = TaskContext.get().partitionId(), 0
        rest, names = np.zeros(0, "<u2"), None  # ids that fill no record yet, and their documents with the places of their ids

        def records(stream: np.ndarray, owners: pa.Array, starts: np.ndarray, used: int) -> pa.RecordBatch:
            begin = np.arange(0, used, layout.length)
            first = np.searchsorted(starts, begin, "right") - 1
            last = np.searchsorted(starts, np.minimum(begin + layout.length, len(stream)) - 1, "right") - 1
            count = last - first + 1
            rows = np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)
            docs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), owners.take(pa.array(rows)))
            held = np.minimum(len(stream) - begin, layout.length)
            full = np.full(len(begin) * layout.length, layout.end, "<u2")
            full[:min(used, len(stream))] = stream[:used]
            ids = pa.array([r.tobytes() for r in full.reshape(-1, layout.length)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([task] * len(begin), pa.int32()), pa.array(done + np.arange(len(begin)), pa.int64()),
                                               docs, pa.array(held, pa.int64()), ids], names=["task", "number", "doc_ids", "n_tokens", "ids"])

        for batch in batches:
            ids = [np.array([*coder.encode_ordinary(t.as_py() or ""), layout.end], "<u2") for t in batch.column("text")]
            starts = np.cumsum([0, *map(len, ids)])[:-1] + len(rest)
            owners = batch.column("doc_id")
            if names is not None:
                owners, starts = pa.concat_arrays([names[0], owners]), np.concatenate([names[1], starts])
            stream = np.concatenate([rest, *ids])
            used = len(stream) // layout.length * layout.length
            if used:
                yield records(stream, owners, starts, used)
            done += used // layout.length
            keep = max(0, int(np.searchsorted(starts, used, "right")) - 1)
            rest, names = stream[used:], (owners.slice(keep), np.maximum(starts[keep:] - used, 0)) if len(stream) > used else None
        if names is not None:
            yield records(rest, *names, layout.length)

    made = rows.mapInArrow(encode, f"task int, number bigint, doc_ids array<{kind}>, n_tokens bigint, ids binary")
    return staged(docs.sparkSession, made, "token-ids", compression="zstd", **{"parquet.compression.codec.zstd.level": "6"})


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows``: larger bundles compress better."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _bundles(tokens: DataFrame, layout: Layout, tasks: np.ndarray, offsets: np.ndarray, n: int) -> DataFrame:
    """(shard, bundle): compressed records of one batch that go to one shard."""
    shared = tokens.sparkSession.sparkContext.broadcast((tasks, offsets))  # 16 bytes for each input task

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tasks, offsets = shared.value
        for batch in gathered(batches, BUNDLED):
            base = offsets[np.searchsorted(tasks, np.array(batch.column("task")))]
            slot = permute(base + np.array(batch.column("number"), np.int64), n, layout.key)
            ids = batch.column("ids").cast(pa.binary(layout.stride))
            shard = slot // layout.per_shard
            order = np.argsort(shard, kind="stable")
            edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
            names, blobs = [], []
            for a, b in zip(edges[:-1], edges[1:]):
                of = order[a:b]
                at = pa.array(of)
                rows = pa.RecordBatch.from_arrays([pa.array(slot[of]), batch.column("doc_ids").take(at), batch.column("n_tokens").take(at), ids.take(at)],
                                                  names=["slot", "doc_ids", "n_tokens", "record"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                    out.write_batch(rows)
                blobs.append(sink.getvalue().to_pybytes())
                names.append(int(shard[of[0]]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "bundle"])

    return tokens.mapInArrow(bundle, "shard int, bundle binary")


def materialise(docs: DataFrame, folder: str, layout: Layout = Layout(), ranks: dict[bytes, int] | None = None, **columns: str) -> DataFrame:
    """Write the shards and a manifest to ``folder``; returns the written index, one row a sequence:
    (slot, shard, place, doc_ids, n_tokens, crc), ``doc_ids`` in the order of their ids, ``n_tokens`` without filling, ``crc`` of the record."""
    spark = docs.sparkSession
    tokens = tokenise(docs, layout, ranks or load_ranks(), **columns)
    kind = tokens.schema["doc_ids"].dataType.simpleString()
    per_task = tokens.groupBy("task").agg(F.count(F.lit(1)).alias("n")).orderBy("task").collect()
    counts = np.array([r.n for r in per_task], np.int64)
    n = int(counts.sum())
    shards = -(-n // layout.per_shard)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps({**asdict(layout), "sequences": n, "shards": shards, "type": "uint16 little-endian"}).encode())
    schema = f"slot bigint, shard int, place int, doc_ids {kind}, n_tokens bigint, crc bigint"
    if not n:
        return spark.createDataFrame([], schema)
    bundles = _bundles(tokens, layout, np.array([r.task for r in per_task]), np.cumsum(counts) - counts, n)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid
        parts, shard = [], None
        for batch in batches:
            for name, blob in zip(batch.column("shard"), batch.column("bundle")):
                shard = name.as_py()
                parts.append(pa.ipc.open_stream(blob.as_buffer()).read_all().combine_chunks())
        if shard is None:
            return
        rows = pa.concat_tables(parts).sort_by("slot")  # one shard: at most ``per_shard`` records
        records = [r.as_py() for r in rows.column("record")]
        place = np.array(rows.column("slot"), np.int64) - shard * layout.per_shard
        if not np.array_equal(place, np.arange(len(place))):
            raise ValueError(f"shard {shard} has gaps")
        store, root = fs.FileSystem.from_uri(folder)
        own = f"{root}/.{uuid.uuid4().hex}"
        with store.open_output_stream(own) as out:
            out.write(b"".join(records))
        store.move(own, f"{root}/{shard_name(shard)}")
        for part in rows.drop_columns(["record"]).to_batches(10_000):
            at = np.array(part.column("slot"), np.int64) - shard * layout.per_shard
            yield pa.RecordBatch.from_arrays(
                [part.column("slot"), pa.array([shard] * len(at), pa.int32()), pa.array(at, pa.int32()), part.column("doc_ids"),
                 part.column("n_tokens"), pa.array([zlib.crc32(records[i]) for i in at], pa.int64())],
                names=["slot", "shard", "place", "doc_ids", "n_tokens", "crc"])

    placed = bundles.repartitionById(shards, F.col("shard"))
    return staged(spark, placed.mapInArrow(write, schema), "training-order")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def read_from(folder: str, slot: int = 0, count: int | None = None) -> Iterator[np.ndarray]:
    """Records from a slot on, one sequential read a shard."""
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/manifest.json") as data:
        manifest = json.loads(data.read())
    stop = manifest["sequences"] if count is None else min(manifest["sequences"], slot + count)
    stride = 2 * manifest["length"]
    while slot < stop:
        shard, place = divmod(slot, manifest["per_shard"])
        take = min(stop - slot, manifest["per_shard"] - place)
        with store.open_input_file(f"{root}/{shard_name(shard)}") as data:
            data.seek(place * stride)
            yield from np.frombuffer(data.read(take * stride), "<u2").reshape(take, -1)
        slot += take
