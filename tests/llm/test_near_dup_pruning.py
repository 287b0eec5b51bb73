"""Signatures tell long texts apart, links found by differences are exact, and nothing is left behind."""

import random
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrain.llm import near_dup
from pulsegrain.llm.near_dup import Settings, Signer, least_matches


def dropped(a: bytes, b: bytes, s: Settings) -> bool:
    equal = np.cumsum(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8))
    return any(equal[n - 1] < least for n, least in least_matches(s))


@pytest.mark.parametrize("size", [30, 300, 1000, 5000])
def test_unlike_texts_are_dropped_and_like_ones_kept(size):
    s, rng = Settings(words=2), random.Random(size)
    signer = Signer(s)
    text = lambda words: signer.sign(" ".join(words).encode())["signature"]
    for _ in range(5):
        words = [str(rng.random()) for _ in range(size + 1)]
        other = [str(rng.random()) for _ in range(size + 1)]
        half = words[: size // 2] + other[size // 2:]  # a similarity of a third
        near = words[: size * 19 // 20] + other[size * 19 // 20:]  # of nine tenths
        assert dropped(text(words), text(other), s) and dropped(text(words), text(half), s)
        assert not dropped(text(words), text(near), s)


def plain(texts, s):
    sets = [set(near_dup.Shingler(s.words).hashes(t.encode()).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= s.percent * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return [top(i) for i in range(len(texts))]


@pytest.mark.parametrize("large", [2, 8, 64, 10**6])
def test_components_do_not_depend_on_what_counts_as_large(spark, large):
    rng = random.Random(4)
    core, texts = [f"w{i}" for i in range(80)], []
    for group in range(40):  # families of near copies of one text, just below and above the threshold among each other
        own = list(core)
        for place in rng.sample(range(80), rng.randrange(2, 9)):
            own[place] = f"g{group}-{place}"
        for copy in range(rng.randrange(1, 5)):
            words = list(own)
            for place in rng.sample(range(80), copy):
                words[place] = f"c{rng.randrange(9)}"
            texts.append(" ".join(words))
    s = Settings(words=2, large=large)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = {r.doc_id: r.component_id for r in near_dup.classes(docs, s).select("row.doc_id", "component_id").collect()}
    assert [out[i] for i in range(len(texts))] == plain(texts, s)


def test_only_the_tables_of_the_result_stay(spark):
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(root.iterdir())
    docs = spark.createDataFrame([(i, f"a b c d e f g h i j {i // 3}") for i in range(30)], "doc_id long, text string")
    out = near_dup.classes(docs)
    left = {p.name.rsplit("-", 1)[0] for p in set(root.iterdir()) - before}
    assert left == {"signed", "fates"} and out.count() == 30 and spark.catalog.listTables() == []
    docs = docs.withColumn("text", F.lit(1) / F.col("doc_id"))
    tables = set(root.iterdir())
    with pytest.raises(Exception):  # noqa: B017, PT011
        near_dup.classes(docs)
    assert {p.name.rsplit("-", 1)[0] for p in set(root.iterdir()) - tables} <= {"signed"}
