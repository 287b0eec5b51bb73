"""Mixing sources to target weights by Pareto order sampling.

Every source has a weight and gets that share of all words; a target stops at ``most`` times the words the source
has, and what is over goes to the other sources by weight, until none is above. Within a source a document expects
``e`` copies, more for longer documents, so that the expected words make up the target:
``e = r * (1 + spread * (w / mean(w) - 1))`` with ``r = target / words`` and ``w = ceil(sqrt(size))``, the mean weighted
by size, and ``spread`` as large as keeps every ``e`` within 0 and ``most``. The whole part of ``e`` is
taken for certain. The rest ``p = e - floor(e)`` is a Pareto sample: documents are ranked by
``(u / (1 - u)) / (p / (1 - p))`` with ``u`` from a keyed digest of the id, and taken in that order while they fit into
the words left of the target; then the one document that comes nearest to what is missing is added.

The ranks are cut without sorting a source: words are summed over ``BINS`` slices of the rank scale in the map tasks,
and only the slice in which the target is reached is put in order.

Defined cases: NULL text has size 0 and takes nothing. The NULL source is a source. Rows with equal id, source
and size rank alike, and are taken or left together. A source without words has target 0. The choice depends on ids,
sizes, sources and ``key`` only: reruns agree. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrain.llm.common import WORD, fresh, staged

BINS = 1 << 16
MOST_SOURCES = 100_000
FACTS = "source_size bigint, target double, ratio double, spread double, mean_weight double"


def targets(sizes: dict, weights: dict, most: float) -> dict:
    """Target words by source: shares of all words, none above ``most`` times its own."""
    left, full, open_ = float(sum(sizes.values())), {}, dict(sizes)
    while open_:
        unit = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * unit > most * sizes[s]]
        if not over:
            return full | {s: weights[s] * unit for s in open_}
        for s in over:
            full[s] = most * float(open_.pop(s))
            left -= full[s]
    return full


def in_turn(sources: list) -> dict:
    """Weights 1, 2, 3, 1, ... in code point order of the sources, NULL last."""
    return {s: i % 3 + 1 for i, s in enumerate(sorted(sources, key=lambda s: (s is None, (s or "").encode())))}


def uniform(doc_id: Column, key: str) -> Column:
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(key), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def with_copies(docs: DataFrame, names: dict[str, str], doc_id: str = "doc_id", text: str = "text", source: str = "source",
                weights: dict | None = None, most: float = 3.0, key: str = "mix") -> DataFrame:
    """``docs`` with the columns ``names['size']``, ``names['source_size']``, ``names['target']`` and ``names['copies']``."""
    spark = docs.sparkSession
    size_of = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("bigint")
    weight_of = lambda size: F.ceil(F.sqrt(size)).cast("bigint")
    slim = staged(spark, docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{source}`").alias("src"), size_of.alias("size")), "mix-sizes")
    totals = slim.groupBy("src").agg(F.sum("size").alias("size"), F.sum(F.col("size") * weight_of(F.col("size"))).alias("weighed"),
                                     F.max(weight_of(F.col("size"))).alias("top")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: group them first")
    sizes = {r.src: r.size for r in totals}
    weights = in_turn(list(sizes)) if weights is None else {s: weights[s] for s in sizes}
    goal, facts = targets(sizes, weights, most), []
    for r in totals:
        if r.size:
            ratio, mean = goal[r.src] / r.size, r.weighed / r.size
            rise = r.top / mean - 1
            spread = min(1.0, (most / ratio - 1) / rise) if ratio and rise > 0 else 0.0
            facts.append((r.src, r.size, goal[r.src], ratio, max(0.0, spread), mean))
        else:
            facts.append((r.src, 0, 0.0, 0.0, 0.0, 1.0))
    kind = docs.select(F.col(f"`{source}`").alias("src")).schema[0].dataType.simpleString()
    known = spark.createDataFrame(facts, f"src {kind}, {FACTS}")

    def expected(size: Column) -> Column:
        e = F.col("ratio") * (F.lit(1.0) + F.col("spread") * (weight_of(size) / F.col("mean_weight") - F.lit(1.0)))
        return F.greatest(F.lit(0.0), F.least(F.lit(most), e))

    def rank(doc_id: Column, size: Column) -> Column:
        """Between 0 and 1, in the order of the Pareto rank; 2 without a chance."""
        p, u = expected(size) - F.floor(expected(size)), uniform(doc_id, key)
        q = u * (F.lit(1.0) - p)
        return F.when(p > 0, q / (q + p * (F.lit(1.0) - u))).otherwise(F.lit(2.0))

    same = slim["src"].eqNullSafe(known["src"])
    ranked = slim.join(known, same).select(known["src"].alias("src"), "size", "target", (F.floor(expected(F.col("size"))) * F.col("size")).alias("sure"),
                                           rank(F.col("id"), F.col("size")).alias("rank"))
    # Staged without the id: two passes follow.
    ranked = staged(spark, ranked, "mix-ranks")
    bin_of = F.least(F.floor(F.col("rank") * BINS), F.lit(2 * BINS)).cast("int")
    slices = ranked.groupBy("src", bin_of.alias("slice")).agg(F.sum("size").alias("words"), F.sum("sure").alias("sure"), F.first("target").alias("target"))
    slices = staged(spark, slices, "mix-slices")
    rest = slices.groupBy(F.col("src").alias("of")).agg((F.first("target") - F.sum("sure")).alias("rest"))
    filled = F.expr("sum(words) over (partition by src order by slice rows unbounded preceding)")
    reached = (slices.where(F.col("slice") <= BINS).select("src", "slice", "words", filled.alias("filled"))
               .join(rest, F.expr("src <=> of"))
               .where("filled >= rest and filled - words < rest")
               .select("src", "slice", F.expr("rest - (filled - words)").alias("need")).collect())  # one row a source
    cuts = {r.src: (r.slice, r.need) for r in reached}
    needs = spark.createDataFrame([(s, *c) for s, c in cuts.items()], f"of {kind}, at int, need double")
    edge = (ranked.where("rank <= 1").withColumn("slice", bin_of).join(needs, F.expr("src <=> of and slice = at"))
            .groupBy("src", "rank", "need").agg(F.sum("size").alias("size"))
            .withColumn("filled", F.expr("sum(size) over (partition by src order by rank rows unbounded preceding)")))
    last = {r.src: r for r in edge.where("filled <= need").groupBy("src").agg(F.max("rank").alias("cut"), F.max("filled").alias("filled")).collect()}
    left = {r.of: r.rest for r in rest.collect()}

    def cut(s) -> float:
        if s in cuts:  # the last document of the slice that still fits, or all before the slice
            return last[s].cut if s in last else math.nextafter(cuts[s][0] / BINS, -1.0)
        return -1.0 if left.get(s, 0.0) <= 0 else 1.0

    # What is missing then is filled by the one document beyond the cut that comes nearest to it, if any does.
    gaps = [(s, cut(s), float(need - (last[s].filled if s in last else 0))) for s, (_, need) in cuts.items()]
    off = F.abs(F.col("size") - F.col("gap"))
    nearest = (ranked.where("rank <= 1").join(spark.createDataFrame(gaps, f"of {kind}, cut double, gap double"), F.expr("src <=> of and rank > cut"))
               .where(off < F.col("gap")).groupBy("src").agg(F.min(F.struct(off.alias("off"), "rank")).alias("best")).collect())
    extra_rank = {r.src: r.best.rank for r in nearest}

    # The facts hold one row a source, at most MOST_SOURCES; Spark broadcasts them only below its threshold.
    final = spark.createDataFrame([(*f, cut(f[0]), extra_rank.get(f[0], -1.0)) for f in facts],
                                  f"src {kind}, {FACTS}, cut double, extra double")
    row, fact, n = fresh(docs, "_doc"), fresh(docs, "_fact"), fresh(docs, "_size")
    held = docs.withColumn(n, size_of).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), F.col(n))
    joined = held.join(final, F.col(f"{row}.`{source}`").eqNullSafe(final["src"]))
    own = rank(F.col(f"{row}.`{doc_id}`"), F.col(n))
    copies = F.floor(expected(F.col(n))) + F.when((own <= F.col("cut")) | (own == F.col("extra")), 1).otherwise(0)
    extra = {"size": F.col(n), "source_size": F.col("source_size"), "target": F.col("target"), "copies": copies.cast("bigint")}
    return joined.select(*(F.col(f"{row}.`{c}`").alias(c) for c in docs.columns), *(v.alias(names[k]) for k, v in extra.items()))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix: each document as often as it is taken, with the columns of ``docs``."""
    names = {k: fresh(docs, f"_mix_{k}") for k in ("size", "source_size", "target", "copies")}
    taken = names["copies"]
    times = F.explode(F.array_repeat(F.lit(0), F.col(taken).cast("int"))).alias(taken)
    return with_copies(docs, names, **options).select(*(F.col(f"`{c}`") for c in docs.columns), times).drop(taken)
