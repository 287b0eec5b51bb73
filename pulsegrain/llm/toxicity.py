"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a fixed word list and of a list learned from labelled rows (word beginnings that
toxic rows use far more often), how near list words stand to second-person words, capitals, exclamation and other
punctuation, and how many words are disguised with digits or signs. Trees (Spark ML) are fitted on the labelled
rows handed in but for a part kept back, on which isotonic regression learns the calibration.

The learned list is drawn from at most about ``SAMPLE`` labelled rows and holds at most ``LEARNED`` beginnings of words
(parameters); features, trees and scores cover all rows. Features are written once, so training re-reads numbers,
not texts.

Defined cases: NULL, empty and wordless texts have all features 0 and get the score of such a row. Rows without an
id or label are not learned from; several labels of one id count as their largest. Without both labels among the
rows to learn from, every score is their mean (0 without rows). Equal texts get equal scores.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrain.llm.common import staged

SAMPLE = 20_000
LEARNED = 1000
STEMS = (4, 5, 6, 7)
# Insults, second-person words, and what signs stand for in disguised words.
INSULTS = frozenset("""ass bastard bitch clown crap creep cretin damn degenerate disgusting dumb filth fool freak garbage
hate idiot imbecile jerk kill liar loser moron pathetic pig rat retard scum shit shut stupid trash ugly useless vermin
vile worthless""".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros".split())
SIGNS = str.maketrans("013457@$!", "oieastasi")
WORD = re.compile(r"\S+")
STRIPPED = re.compile(r"^[\W_]+|[\W_]+$")
# The number of words counts up to 1000: beyond that length says nothing more.
NAMES = ("words", "insults", "insult_share", "learned", "learned_share", "learned_kinds", "learned_top", "learned_sum",
         "near_second", "near_share", "second_share", "capital_share", "shout_share", "exclaim_share", "sign_share", "disguised", "disguised_share")


def plain(word: str) -> str:
    return STRIPPED.sub("", word).lower()


def stems(text: str) -> set[str]:
    """Whole words (marked) and beginnings of words."""
    words = {plain(w) for w in set(WORD.findall(text))}
    return {f"={w}" for w in words if w} | {w[:n] for w in words for n in STEMS if len(w) >= n}


class Measurer:
    def __init__(self, learned: dict[str, float]):
        self.learned, self.known = learned, {}

    def facts(self, word: str) -> tuple[bool, float, str, bool, bool, bool]:
        """Insult, learned weight, plain form, second person, shouted, disguised."""
        low = plain(word)
        open_ = plain(word.translate(SIGNS)) if low and not low.isalpha() else low
        hit, cut = low in INSULTS, open_ != low and open_ in INSULTS
        weight = max((self.learned.get(s, 0.0) for s in (f"={low}", *(low[:n] for n in STEMS if len(low) >= n))), default=0.0)
        return hit or cut, weight, low, low in SECOND, len(low) > 2 and word.isupper(), cut or (not low.isalpha() and any(c.isalpha() for c in low))

    def measure(self, text: str | None) -> list[float]:
        words = WORD.findall(text) if text else []
        if not words:
            return [0.0] * len(NAMES)
        known, hits, learned, second, shouted, disguised = self.known, [], [], [], 0, 0
        for i, word in enumerate(words):
            fact = known.get(word)
            if fact is None:
                fact = self.facts(word)
                fact = fact if any((fact[0], fact[1], fact[3], fact[4], fact[5])) else False
                if len(known) < 1 << 20 and len(word) < 100:
                    known[word] = fact
            if not fact:
                continue
            if fact[0]:
                hits.append(i)
            if fact[1]:
                learned.append((i, fact[1], fact[2]))
            if fact[3]:
                second.append(i)
            shouted += fact[4]
            disguised += fact[5]
        n, chars = len(words), len(text)
        spots = np.array(sorted({*hits, *(i for i, _, _ in learned)}), np.int64)
        near = 0
        if len(spots) and second:
            at = np.array(second)
            after = np.searchsorted(at, spots)
            gap = np.minimum(np.abs(at[np.minimum(after, len(at) - 1)] - spots), np.abs(spots - at[np.maximum(after - 1, 0)]))
            near = int((gap <= 5).sum())
        weights = [w for _, w, _ in learned]
        letters = sum(map(str.isupper, text))
        return [float(v) for v in (
            min(n, 1000), len(hits), len(hits) / n, len(learned), len(learned) / n, len({w for _, _, w in learned}), max(weights, default=0), sum(weights) / n,
            near, near / n, len(second) / n, letters / chars, shouted / n, text.count("!") / chars, sum(map(text.count, "#$%&*?@")) / chars, disguised, disguised / n)]


def learn_words(rows: DataFrame, sample: int = SAMPLE, most: int = LEARNED) -> dict[str, float]:
    """Log odds of words and beginnings of words that speak for label 1; ``rows`` (id, text, label)."""
    total = rows.agg(F.count(F.lit(1)).alias("n")).first().n
    if total > sample:
        rows = rows.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) < int(sample / total * (1 << 30)))

    def find(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(stems(t.as_py() or "")) for t in texts], pa.list_(pa.string()))

    n = F.struct(F.count(F.lit(1)).alias("all"), F.sum("label").alias("toxic"))
    everything = rows.agg(n.alias("n")).first().n
    toxic, clean = everything.toxic or 0, everything["all"] - (everything.toxic or 0)
    if not toxic or not clean:
        return {}
    p, q = (F.col("toxic") + 0.5) / (toxic + 1), (F.col("seen") - F.col("toxic") + 0.5) / (clean + 1)
    counted = (rows.select("label", F.explode(F.arrow_udf(find, "array<string>")("text")).alias("stem"))
               .groupBy("stem").agg(F.count(F.lit(1)).alias("seen"), F.sum("label").alias("toxic")).where("toxic >= 4"))
    weighed = counted.withColumn("odds", F.log(p / q)).where("odds > 1.2")
    # How surprising the count is: Poisson deviance against the share of toxic rows.
    mean = F.col("seen") * (toxic / (toxic + clean))
    weighed = weighed.withColumn("gain", F.col("toxic") * F.log(F.col("toxic") / mean) - (F.col("toxic") - mean)).where("gain > 6")
    return {r.stem: r.odds for r in weighed.orderBy(F.desc("gain"), "stem").limit(most).collect()}


def measure(docs: DataFrame, learned: dict[str, float], features: str = "features", text: str = "text") -> DataFrame:
    """``docs`` with the array of features (``NAMES``)."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)  # at most LEARNED entries
    made = []

    def run(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Measurer(shared.value))
        return pa.array([made[0].measure(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return docs.withColumn(features, F.arrow_udf(run, "array<double>")(F.col(f"`{text}`")))


def score(docs: DataFrame, labels: DataFrame, learn_from: Column, calibrate_on: Column, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic", rounds: int = 20, depth: int = 3) -> DataFrame:
    """(doc_id, score) for every row. ``learn_from`` and ``calibrate_on`` (a part of it) are conditions on ``id``."""
    spark = docs.sparkSession
    marks = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").alias("label")).where("id is not null and label is not null and label in (0, 1)")
    marks = staged(spark, marks.groupBy("id").agg(F.max("label").cast("double").alias("label")).where(learn_from), "marks")
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    learned = learn_words(texts.join(marks, "id"))
    made = staged(spark, measure(texts, learned).select("id", "features"), "toxic-features")
    known = staged(spark, made.join(marks, "id").select("id", "label", "features"), "toxic-train")
    vector = array_to_vector(F.col("features")).alias("features")
    held = calibrate_on
    fit_on = known.where(~held).select("label", vector)
    shape = {r.label: r.n for r in fit_on.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shape) < 2:
        mean = shape.get(1.0, 0) / max(1, sum(shape.values()))
        return made.select(F.col("id").alias("doc_id"), F.lit(float(mean)).alias("score"))
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7, minInstancesPerNode=3).fit(fit_on)

    def chance(rows: DataFrame, *columns: str) -> DataFrame:
        return trees.transform(rows.select(*columns, vector)).select(*columns, vector_to_array("probability")[1].alias("raw"))

    calibration = chance(known.where(held), "label").select("label", F.col("raw").alias("features"))
    out = chance(made, "id")
    if calibration.limit(1).count():
        # Weighted by counts of equal raw scores, as trees give few different ones.
        counted = calibration.groupBy("features").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
        fitted = IsotonicRegression(labelCol="label", featuresCol="features", weightCol="weight").fit(counted)
        out = fitted.transform(out.withColumnRenamed("raw", "features")).withColumnRenamed("prediction", "raw")
    return out.select(F.col("id").alias("doc_id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw"))).alias("score"))
