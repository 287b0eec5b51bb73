"""Large groups of near copies meet few centres; staged rows move in small batches."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pulsegrain.llm import common, near_dup


def test_near_copies_meet_few_centres(spark, monkeypatch):
    draw, judged, confirmed = np.random.default_rng(3), [], near_dup._confirmed
    words = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(300):
        own = list(words)
        own[draw.integers(200)] = f"x{i}"
        texts.append((i, " ".join(own)))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")

    def counted(pairs, *rest):
        judged.append(pairs.count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(near_dup, "_confirmed", counted)
    out = near_dup.classes(docs, near_dup.Settings(words=2)).select("component_id").distinct().collect()
    assert [r.component_id for r in out] == [0]
    assert sum(judged) <= 2 * len(texts)


def test_staged_rows_move_in_small_batches(spark):
    before = {key: spark.conf.get(key) for key in common.BATCHES}

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    for rows, width in ((9000, 10), (300, 100_000)):
        made = spark.range(0, rows, 1, 1).select(F.expr(f"repeat('x', {width})").alias("text")).mapInArrow(sizes, "n bigint, bytes bigint")
        got = common.staged(spark, made, "sizes").agg(F.sum("n"), F.max("n"), F.max("bytes")).first()
        assert got[0] == rows and got[1] <= 2000 and got[2] <= 5_000_000
    assert before == {key: spark.conf.get(key) for key in common.BATCHES}


def test_remembered_words_are_bounded():
    shingler = near_dup.Shingler(2)
    first = shingler.hashes(" ".join(f"w{i}" for i in range(100_000)).encode())
    assert len(shingler.known) <= 1 << 16
    assert (first == near_dup.Shingler(2).hashes(" ".join(f"w{i}" for i in range(100_000)).encode())).all()


def _made(node, kind):
    """Output rows of the nodes of this kind in an executed plan."""
    own = node.metrics().get("numOutputRows").get().value() if node.nodeName().startswith(kind) else 0
    if node.nodeName() == "AdaptiveSparkPlan":
        return _made(node.executedPlan(), kind)
    if node.nodeName().endswith("QueryStage"):
        return _made(node.plan(), kind)
    return own + sum(_made(node.children().apply(i), kind) for i in range(node.children().size()))


def test_only_differences_that_can_pair_are_exploded(spark, monkeypatch):
    draw, rows, exploded, staged = np.random.default_rng(5), [], {}, near_dup.staged
    sizes = {}
    for i in range(400):  # one or two words from the centre, and families as far from each other as a link allows
        own = [f"w{j}" for j in range(60)]
        for place in draw.choice(60, 1 + i % 2 if i < 100 else 7, replace=False):
            own[place] = f"x{i}-{place}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")

    def watched(session, df, name, *rest, **options):
        if name in ("frequent-differences", "rare-differences", "difference-pairs"):
            df.collect()
            exploded[name] = _made(df._jdf.queryExecution().executedPlan(), "Generate")
        out = staged(session, df, name, *rest, **options)
        if name in ("core-differences", "difference-pairs"):
            sizes[name] = out.agg(F.sum(F.size("d"))).first()[0] if name == "core-differences" else out.count()
        return out

    monkeypatch.setattr(near_dup, "staged", watched)
    s = near_dup.Settings(words=2, large=8)
    got = {r.doc_id: r.component_id for r in near_dup.classes(docs, s).select("row.doc_id", "component_id").collect()}
    monkeypatch.undo()
    assert got == {r.doc_id: r.component_id for r in near_dup.classes(docs, near_dup.Settings(words=2, large=10**6)).select("row.doc_id", "component_id").collect()}
    assert sizes["core-differences"] > 4000 and 0 < sum(exploded.values()) < 0.75 * sizes["core-differences"]


def test_frequent_differences_of_a_batch():
    d = [[1, 2], [1, 3], [-5, 1]] + [[1, 100 + i] for i in range(97)] + [[], [7]]
    reference = pa.array([4] * 100 + [9] * 2)
    batch = pa.RecordBatch.from_arrays([reference, pa.array([1000] * 100 + [2] * 2), pa.array(d, pa.list_(pa.int64()))], names=["reference", "size", "d"])
    out = [tuple(r.values()) for b in near_dup._often([batch, batch.slice(0, 0), batch.slice(100, 1)]) for r in b.to_pylist()]
    assert out == [(4, 1000, 1, 100), (9, 2, 7, 1)]
