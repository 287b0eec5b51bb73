"""Trie of conversation prefixes with totals over subtrees, by centroid decomposition of its parent edges.

1. ``numbered`` sorts turns over all tasks by conversation and turn (a long conversation lies in several tasks) and counts
   them there; conversations that span tasks, one a task at most, get what came before added.
2. ``paths`` gives each conversation's prefixes a 128-bit digest: the exclusive or of a hash of place and turn, taken in
   slices of ``SLICE`` turns and then over the slices. Equal digests are one node, named by its smallest conversation and
   its depth.
3. ``rollup`` sums values over subtrees. A node's weight is the number of its members, so the weight of a whole
   subtree is known from the paths alone. In each round every component with more than ``per_task`` nodes finds its
   centroid (the deepest node that holds over half of the weight), sums up what hangs below it, adds the sum to the nodes
   from the centroid to the top, and falls apart into the centroid's child subtrees and what is above. No part has
   more than half of the weight, so rounds grow with the logarithm of the input, whatever the depth. Smaller components go
   on by the same steps inside a task, many in one.

Defined cases: NULL roles and texts are empty; turns sort with NULL first, equal ones by their digest; rows without a
``conv_id`` belong to no conversation; repeated rows are turns of their own. Long texts are only hashed and measured.
An empty table gives no node. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrain.llm.common import staged

SLICE = 1024
PER_TASK = 1 << 13
NODE = "rep bigint, depth bigint"
TURN = "conv_id bigint, key string, bytes bigint"
VALUES = ("leaves", "saved")


def numbered(turns: DataFrame) -> DataFrame:
    """``TURN`` and ``no``, the place of each turn in its conversation (from 1); written."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task, first, last, done = TaskContext.get().partitionId(), None, None, 0
        for batch in batches:
            conv = batch.column("conv_id").to_numpy(zero_copy_only=False)
            if not len(conv):
                continue
            first = conv[0] if first is None else first
            run = np.flatnonzero(np.diff(conv, prepend=conv[0]) != 0)
            begin = np.zeros(len(conv), np.int64)
            begin[run] = run
            no = np.arange(1, len(conv) + 1) - np.maximum.accumulate(begin)
            if conv[0] == last:
                no[:run[0] if len(run) else len(no)] += done
            last, done = conv[-1], no[-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "key", "bytes")), pa.array(no), pa.array(np.full(len(no), task)),
                                              pa.array(conv == first)], names=["conv_id", "key", "bytes", "local", "task", "first"])

    spark = turns.sparkSession
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("key")]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "bytes")
    rows = staged(spark, dealt.mapInArrow(count, f"{TURN}, local bigint, task bigint, first boolean"), "turns")
    spanning = rows.where("first").select("conv_id").distinct()  # each task's first conversation: one that spans tasks is among them
    counts = rows.join(F.broadcast(spanning), "conv_id").groupBy("conv_id", "task").agg(F.max("local").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("conv_id", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).where("before > 0")
    return staged(spark, rows.join(F.broadcast(before), ["conv_id", "task"], "left").select(
        "conv_id", "key", "bytes", (F.col("local") + F.coalesce("before", F.lit(0))).alias("no")), "numbered")


def turn_keys(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, key, bytes): digest of role and text, and the bytes of the text, which go no further."""
    who, said = F.coalesce(F.col(f"`{role}`"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256)
    return conversations.select(F.col(f"`{conv_id}`").cast("bigint").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), key.alias("key"),
                                F.octet_length(said).cast("bigint").alias("bytes")).where("conv_id is not null")


def rebuilt(turns: DataFrame, source: Column, shared: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Each conversation with its first ``shared`` turns (at most ``most``) replaced by those of the conversation ``source``.

    ``turns`` are ``numbered``. Returns (conv_id, pos, key, bytes, size) and (conv_id, size), size being the number of turns.
    """
    heads = turns.where(F.col("no") <= most).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("no", "key", "bytes"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.max("no").alias("n")).select("conv_id", "n", source.alias("source"), shared.alias("shared"))
    convs = convs.join(heads.withColumnRenamed("conv_id", "source"), "source", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("shared").cast("int")))
    size = F.size("head") + F.greatest(F.col("n") - F.col("shared"), F.lit(0))
    convs = staged(turns.sparkSession, convs.select("conv_id", "shared", "head", size.alias("size")), "rebuilt")
    taken = convs.select("conv_id", "size", F.inline("head")).select("conv_id", F.col("no").alias("pos"), "key", "bytes", "size")
    short = convs.select("conv_id", "shared", "size", F.size("head").alias("taken"))
    own = turns.join(short, "conv_id").where("no > shared").select("conv_id", (F.col("no") - F.col("shared") + F.col("taken")).alias("pos"), "key", "bytes", "size")
    return taken.union(own), convs.select("conv_id", "size")


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, bytes, size) with the digests ``a``, ``b`` of the prefix and ``pa``, ``pb`` of the one before; written."""
    lane = lambda seed: F.xxhash64(F.lit(seed), "key", "pos")
    rows = turns.select("conv_id", "pos", "bytes", "size", lane(1).alias("x"), lane(2).alias("y"), F.expr(f"(pos - 1) div {SLICE}").alias("slice"))
    upto = Window.partitionBy("conv_id", "slice").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "slice", "pos", "bytes", "size", "x", "y", F.bit_xor("x").over(upto).alias("a"), F.bit_xor("y").over(upto).alias("b"))
    rows = staged(turns.sparkSession, rows, "slices")
    long_ones = rows.where(F.col("size") > SLICE)
    sums = long_ones.groupBy("conv_id", "slice").agg(F.bit_xor("x").alias("sx"), F.bit_xor("y").alias("sy"))
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "slice", F.coalesce(F.bit_xor("sx").over(earlier), F.lit(0)).alias("ox"), F.coalesce(F.bit_xor("sy").over(earlier), F.lit(0)).alias("oy"))
    xor = lambda c, by: F.col(c).bitwiseXOR(F.col(by))
    fixed = long_ones.join(sums, ["conv_id", "slice"]).withColumns({"a": xor("a", "ox"), "b": xor("b", "oy")})
    whole = rows.where(F.col("size") <= SLICE).unionByName(fixed.drop("ox", "oy"))
    return staged(turns.sparkSession, whole.select("conv_id", F.col("pos").alias("depth"), "bytes", "size", "a", "b", xor("a", "x").alias("pa"), xor("b", "y").alias("pb")), "paths")


def trie(steps: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (rep, depth, up, n_convs, weight, bytes) and steps (conv_id, depth, rep, up, size), the root's included; both written.

    ``up`` is the name of the node above (its depth is one less); the weight counts the steps in the subtree.
    """
    spark = steps.sparkSession
    root = convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("bytes"), "size",
                        *(F.lit(0).cast("bigint").alias(c) for c in ("a", "b", "pa", "pb")))
    steps = steps.union(root)
    nodes = steps.groupBy("depth", "a", "b").agg(
        F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"),
        F.sum(F.col("size") - F.col("depth") + 1).alias("weight"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    nodes = staged(spark, nodes, "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("rep").alias("up"))
    nodes = staged(spark, nodes.join(above, ["depth", "pa", "pb"], "left").select("rep", "depth", "up", "n_convs", "weight", "bytes", "a", "b"), "trie")
    named = steps.select("conv_id", "depth", "size", "a", "b").join(nodes.select("depth", "a", "b", "rep", "up"), ["depth", "a", "b"])
    return nodes.drop("a", "b"), staged(spark, named.select("conv_id", "depth", "rep", "up", "size"), "steps")


def split(parents: list[int], weights: list[int], values: list[list[int]]) -> list[list[int]]:
    """Sums over subtrees of one component, by recursive splitting; its top is node 0, and parents come before children."""
    out = [[0] * len(parents) for _ in values]
    waiting = [list(range(len(parents)))]
    while waiting:
        part = waiting.pop()
        top, weight = part[0], {v: weights[v] for v in part}
        for v in reversed(part[1:]):
            weight[parents[v]] += weight[v]
        centroid = next(v for v in reversed(part) if 2 * weight[v] > weight[top])  # these form one path from the top
        under, pieces, above = {}, {}, []
        for v in part:
            if v != centroid:
                up = parents[v] if v != top else None
                piece = v if up == centroid else under.get(up)
                if piece is None:
                    above.append(v)
                else:
                    under[v] = piece
                    pieces.setdefault(piece, []).append(v)
        for totals, value in zip(out, values):
            total = value[centroid] + sum(value[v] for v in under)
            v = centroid
            while True:
                totals[v] += total
                if v == top:
                    break
                v = parents[v]
        waiting.extend(pieces.values())
        if above:
            waiting.append(above)
    return out


def _finish(parts: DataFrame) -> DataFrame:
    """The same splitting inside tasks, for components that a task can hold; adds to what they have got already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["top_rep", "top_depth", "rep", "depth", "up", "weight", *VALUES, *(f"got_{v}" for v in VALUES)]

        def done(rows: list[tuple]) -> tuple[list, ...]:
            at = {(r[2], r[3]): i for i, r in enumerate(rows)}
            parents = [-1, *(at[r[4], r[3] - 1] for r in rows[1:])]
            own = [r[5] for r in rows]
            for r, up in zip(rows[1:], parents[1:]):
                own[up] -= r[5]  # weights are those of subtrees here
            sums = split(parents, own, [[r[6 + k] for r in rows] for k in range(len(VALUES))])
            return [r[2] for r in rows], [r[3] for r in rows], *([s + r[6 + len(VALUES) + k] for s, r in zip(total, rows)] for k, total in enumerate(sums))

        out: list[list] = [[], [], *([] for _ in VALUES)]
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["rep", "depth", *VALUES])
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in names)):
                if rows and rows[0][:2] != row[:2]:
                    for column, more in zip(out, done(rows)):
                        column.extend(more)
                    rows = []
                rows.append(row)
            if out[0]:
                yield flush()
                out = [[], [], *([] for _ in VALUES)]
        if rows:
            for column, more in zip(out, done(rows)):
                column.extend(more)
            yield flush()

    dealt = parts.repartition("top_rep", "top_depth").sortWithinPartitions("top_rep", "top_depth", "depth", "rep")
    return dealt.mapInArrow(run, f"{NODE}, " + ", ".join(f"{v} bigint" for v in VALUES))


def rollup(nodes: DataFrame, steps: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """(rep, depth, *VALUES): the ``VALUES`` of ``nodes`` summed over each node's subtree, itself included."""
    spark = nodes.sparkSession
    got = [f"got_{v}" for v in VALUES]
    state = ["top_rep", "top_depth", "rep", "depth", "up", "weight", *VALUES, *got]
    root = nodes.where("depth = 0").select("rep").first()
    if root is None:
        return nodes.select("rep", "depth", *VALUES)
    begin = {"top_rep": root.rep, "top_depth": 0} | dict.fromkeys(got, 0)
    parts = staged(spark, nodes.withColumns({c: F.lit(v).cast("bigint") for c, v in begin.items()}).select(*state), "parts")
    small, finished = [], []
    while True:
        sizes = staged(spark, parts.groupBy("top_rep", "top_depth").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("whole")), "sizes")
        sized = parts.join(sizes, ["top_rep", "top_depth"])
        small.append(sized.where(F.col("n") <= per_task).select(*state))
        large = sized.where(F.col("n") > per_task)
        if sizes.where(F.col("n") > per_task).isEmpty():
            break
        deepest = F.min_by(F.struct("rep", "depth", "weight"), "weight")  # of the nodes with over half of the weight: one path
        centres = staged(spark, large.where("2 * weight > whole").groupBy("top_rep", "top_depth").agg(deepest.alias("c")).select(
            "top_rep", "top_depth", F.col("c.rep").alias("c_rep"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight")), "centroids")
        placed = large.select(*state).join(centres, ["top_rep", "top_depth"])
        # The step of a node's own path just under the centroid tells whether it hangs below the centroid, and in which piece.
        down = steps.select(F.col("conv_id").alias("rep"), F.col("depth").alias("d_depth"), F.col("rep").alias("d_rep"), F.col("up").alias("d_up"))
        at = F.when(F.col("depth") > F.col("c_depth"), F.col("c_depth") + 1)
        placed = placed.withColumn("d_depth", at).join(down, ["rep", "d_depth"], "left")
        below = F.coalesce(F.col("d_up") == F.col("c_rep"), F.lit(False))
        centre = (F.col("rep") == F.col("c_rep")) & (F.col("depth") == F.col("c_depth"))
        placed = staged(spark, placed.withColumns({"below": below, "centre": centre}), "placed")
        totals = placed.where("below or centre").groupBy("top_rep", "top_depth").agg(*(F.sum(v).alias(f"add_{v}") for v in VALUES))
        facts = staged(spark, centres.join(totals, ["top_rep", "top_depth"]), "totals")
        path = steps.join(facts.withColumnRenamed("c_rep", "conv_id"), "conv_id").where("depth between top_depth and c_depth").select(
            "rep", "depth", "c_weight", *(f"add_{v}" for v in VALUES))
        path = path.withColumnRenamed("c_weight", "less")
        kept = placed.join(path, ["rep", "depth"], "left").withColumns({f"got_{v}": F.col(f"got_{v}") + F.coalesce(f"add_{v}", F.lit(0)) for v in VALUES})
        kept = staged(spark, kept.withColumns({
            "weight": F.col("weight") - F.when(F.col("centre"), 0).otherwise(F.coalesce("less", F.lit(0))),
            "top_rep": F.when(F.col("below"), F.col("d_rep")).otherwise(F.col("top_rep")),
            "top_depth": F.when(F.col("below"), F.col("d_depth")).otherwise(F.col("top_depth"))}).select(*state, "centre"), "split")
        finished.append(kept.where("centre").select("rep", "depth", *(F.col(f"got_{v}").alias(v) for v in VALUES)))
        parts = kept.where("not centre").select(*state)
    rest = small[0]
    for part in small[1:]:
        rest = rest.union(part)
    out = _finish(rest)
    for part in finished:
        out = out.union(part)
    return out


def digests(ends: DataFrame, chunk: int = 1 << 14) -> DataFrame:
    """(rep, depth, ids_sha256): SHA-256 of each node's decimal ids in ascending order, comma-joined.

    ``ends`` has (rep, depth, conv_id). Ids are joined to pieces of at most ``chunk`` of them where they were sorted, over
    all tasks; only pieces of a node meet, and run through one hash, piece after piece.
    """
    order = ["rep", "depth", "conv_id"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, depth = (batch.column(c).to_numpy(zero_copy_only=False) for c in order[:2])
            ids = batch.column("conv_id")
            edges = np.flatnonzero((np.diff(rep, prepend=rep[:1] - 1) != 0) | (np.diff(depth, prepend=depth[:1] - 1) != 0)) if len(rep) else np.zeros(0, int)
            at = np.unique(np.concatenate([edges, np.arange(0, len(rep), chunk)])).astype(np.int64)
            text = ids.cast(pa.string()).to_pylist()
            stops = [*at[1:].tolist(), len(text)]
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(depth[at]), ids.take(pa.array(at)),
                                              pa.array([",".join(text[a:b]) for a, b in zip(at.tolist(), stops)], pa.string())], names=["rep", "depth", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        of, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for rep, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("rep", "depth", "ids"))):
                if of == (rep, depth):
                    state.update(b"," + ids.encode())
                else:
                    if of is not None:
                        out.append((*of, state.hexdigest()))
                    of, state = (rep, depth), hashlib.sha256(ids.encode())
            yield _rows(out)
        if of is not None:
            yield _rows([(*of, state.hexdigest())])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                           pa.array([r[2] for r in rows], pa.string())], names=["rep", "depth", "ids_sha256"])

    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, f"{NODE}, first bigint, ids string")
    dealt = pieces.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "first")
    return dealt.mapInArrow(hashed, f"{NODE}, ids_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` (conv_id, pos, key, bytes, size) and ``convs`` (conv_id, size) are those of ``rebuilt``. What sharing saves at a
    node is its bytes for every member but one; ``n_leaves`` and ``saved_tokens`` are sums over the subtree.
    """
    spark = turns.sparkSession
    nodes, steps = trie(paths(turns), convs)
    children = nodes.where("depth > 0").groupBy(F.col("up").alias("rep"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["rep", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = staged(spark, nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("bigint"), "saved": (F.col("n_convs") - 1) * F.col("bytes")}), "valued")
    ends = digests(steps.where(F.col("depth") == F.col("size")).select("rep", "depth", "conv_id"))
    out = nodes.drop(*VALUES).join(rollup(nodes, steps, per_task), ["rep", "depth"]).join(ends, ["rep", "depth"], "left")
    return out.select(F.col("rep").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
                      F.col("saved").alias("saved_tokens"), F.coalesce("ids_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
