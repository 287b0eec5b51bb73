"""Hard negatives: rows of other labels that score nearly as high with an anchor as its best rows of the same label.

Scores are exact integer inner products of quantised vectors, by the method of the Four Russians:

1. ``pack_rows`` writes the rows in blocks: components ``floor(scale * x)`` as two's complement, bit by bit, the bits of
   eight dimensions in a byte, so a row is one byte for each bit plane and group of eight dimensions.
2. For an anchor and a group, a table holds the sums of all 256 subsets of the anchor's eight components. A score is
   made of lookups only: for each plane, from the top one (negative), the sum of the groups' lookups, shifted and added.
3. Anchors are taken in blocks of ``anchors`` rows, read from the written table one partition at a time: a block, its
   tables' source, is broadcast (a set number of rows), and all packed rows are scanned twice. The first scan scores rows
   of the anchor's label and keeps its best; these give each positive's score window. The second scores all other rows and
   keeps the best in each window. Every anchor meets every row exactly once. Tasks hold running lists of a few
   rows an anchor and use the worst of them as a threshold, which leaves out no row that could be among them.

Defined cases: rows with a NULL label, NULL vector or a NULL or non-finite component take no part. Vectors of different
lengths are compared as if filled up with zeros; an empty one scores 0 with all. A NULL id is no anchor, and comes last
among ties. Ids may repeat: a row is not its own positive, its copies are, and copies of an anchor have their own (equal)
results. Labels are integers. A component of 2^31 or more after scaling, or scores that 63 bits might not hold, are an error. An empty table,
or one without anchors, gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pulsegrain.llm.common import staged

BLOCK = 4096  # rows scored at a time
TABLES = 256  # anchors whose tables exist at a time
LAST = np.iinfo(np.int64).max
LEAST = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Settings:
    scale: float = 256
    positives: int = 5
    negatives: int = 3
    low: int = 50  # percent of the positive's score
    high: int = 95
    anchors: int = 1 << 14  # anchors a scan


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
ROWS = "ids array<bigint>, labels array<bigint>, planes binary, n_planes int, n_groups int, most bigint"


def subset_sums(anchors: np.ndarray, groups: int) -> np.ndarray:
    """(group, byte, anchor): sum of the anchor's components in the group whose bits the byte has."""
    filled = np.zeros((len(anchors), 8 * groups), np.int64)
    filled[:, :anchors.shape[1]] = anchors
    parts = filled.reshape(len(anchors), groups, 8)
    out = np.zeros((groups, 256, len(anchors)), np.int64)
    for bit in range(8):
        out[:, 1 << bit:2 << bit] = out[:, :1 << bit] + parts[:, :, bit].T[:, None, :]
    return out


def bit_planes(rows: np.ndarray) -> np.ndarray:
    """(plane, group, row): bytes of the two's complement of the components, the lowest plane first."""
    low, high = (int(rows.min()), int(rows.max())) if rows.size else (0, 0)
    n = max((-1 - low if low < 0 else low).bit_length(), (-1 - high if high < 0 else high).bit_length()) + 1
    return np.stack([np.packbits(((rows >> p) & 1).astype(np.uint8), axis=1, bitorder="little").T for p in range(n)])


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(row, anchor): inner products. ``tables`` may have more groups than the rows; the rest is zero."""
    total = None
    part = np.empty((planes.shape[2], tables.shape[2]), tables.dtype)
    for p in range(len(planes) - 1, -1, -1):
        total = np.zeros_like(part) if total is None else total
        total <<= 1
        for g in range(planes.shape[1]):
            np.take(tables[g], planes[p, g], axis=0, out=part, mode="clip")
            if p == len(planes) - 1:
                total -= part
            else:
                total += part
    return total


def _matrix(vectors: pa.Array, scale: float) -> np.ndarray:
    """Quantised components, short vectors filled up with zeros."""
    flat = np.floor(scale * np.array(vectors.flatten(), np.float64))
    if flat.size and np.abs(flat).max() >= 1 << 31:
        raise ValueError("scaled components must be below 2^31")
    lengths = np.array(vectors.value_lengths(), np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat.astype(np.int64)
    return out


def _usable(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    finite = F.forall(F.col("v"), lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))  # NaN is above infinity
    picked = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("bigint").alias("label"),
                            F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return picked.where(F.col("label").isNotNull() & F.col("v").isNotNull() & finite)


def pack_rows(rows: DataFrame, scale: float) -> DataFrame:
    """Blocks of rows in the order of their ids: ids, labels and bit planes; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = pa.Table.from_batches([batch.slice(at, BLOCK)]).sort_by("id").combine_chunks().to_batches()[0]  # NULL ids last
                q = _matrix(part.column("v"), scale)
                planes = bit_planes(q) if q.shape[1] else np.zeros((1, 0, len(q)), np.uint8)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays(
                    [one(part.column("id")), one(part.column("label")), pa.array([planes.tobytes()], pa.binary()), pa.array([planes.shape[0]], pa.int32()),
                     pa.array([planes.shape[1]], pa.int32()), pa.array([int(np.abs(q).max(initial=0))], pa.int64())],
                    names=["ids", "labels", "planes", "n_planes", "n_groups", "most"])

    return staged(rows.sparkSession, rows.mapInArrow(run, ROWS), "packed-rows")


class Best:
    """The best ``keep`` entries of each slot: higher scores first, then smaller ids, unknown ids last."""

    def __init__(self, slots: int, keep: int):
        self.keep, self.threshold = keep, np.full(slots, LEAST)
        self.slot, self.score, self.id, self.unknown = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        slot, score = np.concatenate([self.slot, slot]), np.concatenate([self.score, score])
        ids, unknown = np.concatenate([self.id, ids]), np.concatenate([self.unknown, unknown])
        order = np.lexsort((ids, unknown, -score, slot))
        begin = np.flatnonzero(np.diff(slot[order], prepend=-1))
        nth = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
        last = order[nth == self.keep - 1]
        self.threshold[slot[last]] = score[last]
        order = order[nth < self.keep]
        self.slot, self.score, self.id, self.unknown = slot[order], score[order], ids[order], unknown[order]

    def offer(self, slots: np.ndarray, grid: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        """``grid`` is (row, slot); ``LEAST`` marks what is no entry. Rows are in the order of their ids."""
        floor = self.threshold[slots]
        new = (floor == LEAST) & ((grid > LEAST).sum(axis=0) > 8 * self.keep)  # these start with their keep-th best here
        if new.any():
            floor[new] = np.partition(grid[:, new], len(grid) - self.keep, axis=0)[len(grid) - self.keep]
        row, col = np.nonzero((grid >= floor) & (grid > LEAST))
        if len(row):
            self.add(slots[col], grid[row, col], ids[row], unknown[row])


def _scan(packed: DataFrame, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, keep: int, windows: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """(slot, id, score): what each task found best. Without ``windows`` a slot is an anchor and takes rows of its label;
    with them, (low, high) by anchor and positive, a slot is one of these and takes rows of other labels inside it."""
    shared = packed.sparkSession.sparkContext.broadcast((ids, labels, q, windows))  # a set number of anchors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, q, windows = shared.value
        per = 1 if windows is None else windows[0].shape[1]
        best = Best(len(ids) * per, keep)
        reach = int(np.abs(q).sum(axis=1).max(initial=0))
        order = np.argsort(labels, kind="stable")
        for batch in batches:
            for block in batch.to_pylist():
                row_labels = np.array(block["labels"], np.int64)
                unknown = np.array([i is None for i in block["ids"]], bool)
                row_ids = np.array([LAST if i is None else i for i in block["ids"]], np.int64)
                planes = np.frombuffer(block["planes"], np.uint8).reshape(block["n_planes"], block["n_groups"], len(row_ids))
                bound = 2 * reach * max(1, block["most"])  # of every sum on the way
                if bound >= 1 << 62:
                    raise ValueError("scores need more than 63 bits")
                kind = np.int32 if bound < 1 << 30 else np.int64
                groups = max(block["n_groups"], -(-q.shape[1] // 8))
                parts = np.split(order, np.flatnonzero(np.diff(labels[order])) + 1) if windows is None else [order]
                for part in parts:
                    for at in range(0, len(part), TABLES):
                        of = part[at:at + TABLES]
                        rows = np.flatnonzero(row_labels == labels[of[0]]) if windows is None else np.arange(len(row_ids))
                        if not len(rows):
                            continue
                        table = subset_sums(q[of], groups).astype(kind)
                        grid = scores(table, planes[:, :, rows]).astype(np.int64) if planes.shape[1] else np.zeros((len(rows), len(of)), np.int64)
                        if windows is None:
                            best.offer(of, grid, row_ids[rows], unknown[rows])
                            continue
                        grid[row_labels[:, None] == labels[of][None, :]] = LEAST
                        for w in range(per):
                            inside = (grid >= windows[0][of, w]) & (grid <= windows[1][of, w])
                            if inside.any():
                                best.offer(of * per + w, np.where(inside, grid, LEAST), row_ids, unknown)
        if len(best.slot):
            yield pa.RecordBatch.from_arrays([pa.array(best.slot), pa.array(best.id, mask=best.unknown), pa.array(best.score)], names=["slot", "id", "score"])

    found = packed.mapInArrow(run, "slot bigint, id bigint, score bigint")
    nth = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("id")))  # ``keep`` rows a task
    return found.withColumn("nth", nth).where(F.col("nth") <= keep)


def _blocks(anchors: DataFrame, scale: float, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, components) of up to ``size`` anchors at a time; the driver holds one block and one partition's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("v"), scale)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([r.tobytes() for r in q], pa.binary())], names=["id", "label", "q"])

    held = []
    rows = staged(anchors.sparkSession, anchors.mapInArrow(run, "id bigint, label bigint, q binary"), "anchors").toLocalIterator()
    while True:
        row = next(rows, None)
        if row is not None:
            held.append(row)
        if held and (row is None or len(held) == size):
            q = [np.frombuffer(r.q, np.int64) for r in held]
            matrix = np.zeros((len(q), max(map(len, q))), np.int64)
            for to, values in zip(matrix, q):
                to[:len(values)] = values
            yield np.array([r.id for r in held], np.int64), np.array([r.label for r in held], np.int64), matrix
            held = []
        if row is None:
            return


def _positives(found: list, ids: np.ndarray, q: np.ndarray, keep: int) -> list[list]:
    """The best ``keep`` (id, score) of each anchor, itself left out once."""
    out, own = [[] for _ in ids], (q * q).sum(axis=1)
    for row in sorted(found, key=lambda r: (r.slot, r.nth)):
        out[row.slot].append((row.id, row.score))
    for a, rows in enumerate(out):
        itself = (int(ids[a]), int(own[a]))
        if itself in rows:
            rows.remove(itself)
        del rows[keep:]
    return out


def mine(vectors: DataFrame, is_anchor: Column, settings: Settings = Settings(), vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``RESULT``, ranked from 1 within anchor and positive; ``is_anchor`` is a condition on the columns ``id`` and ``label``."""
    s, spark = settings, vectors.sparkSession
    rows = _usable(vectors, vec_id, vector, label)
    packed = pack_rows(rows, s.scale)
    out: DataFrame = spark.createDataFrame([], RESULT)
    for ids, labels, q in _blocks(rows.where(F.col("id").isNotNull() & is_anchor), s.scale, s.anchors):
        best = _scan(packed, ids, labels, q, s.positives + 1, None).collect()  # a few rows an anchor of the block
        positives = _positives(best, ids, q, s.positives)
        low, high = np.full((len(ids), s.positives), LAST), np.full((len(ids), s.positives), LEAST)
        facts = []
        for a, of in enumerate(positives):
            for w, (name, score) in enumerate(of):
                low[a, w], high[a, w] = -(-s.low * score // 100), s.high * score // 100
                facts.append((a * s.positives + w, int(ids[a]), name, score))
        if not facts:
            continue
        found = _scan(packed, ids, labels, q, s.negatives, (low, high))
        named = _table(spark, facts).join(found, "slot")
        out = out.union(staged(spark, named.select("anchor_id", "positive_id", F.col("nth").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                                                   "positive_score", F.col("score").alias("negative_score")), "negatives"))
    return out


def _table(spark: SparkSession, facts: list[tuple]) -> DataFrame:
    columns = [pa.array(c, pa.int64()) for c in zip(*facts)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, ["slot", "anchor_id", "positive_id", "positive_score"]))
