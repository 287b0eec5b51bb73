"""Language identification in two steps: the family first, then one-versus-one machines inside it.

A text is its lower-cased letters as UTF-8; the counts of its byte pairs and triples, hashed to ``SIZE`` cells, are square-
rooted and scaled to length 1. Linear support vector machines (squared hinge) are fitted from a
sample of at most about ``SAMPLE`` labelled rows, the same share of each language's rows as ids hash low enough: one
machine per family against the rest, and one for each two languages of a family, which vote. The sample meets in a task,
which fits one machine after the other; the driver gets the weights only. Every text is scored whole, where it is read.

The score is the chance of the family times that of the language in it, both logistic in the margins.

Defined cases: NULL texts and those without any letter are ``und`` with score 0. So is every text where nothing can
be learned. Rows without a language or without an id are never learned from. With a single language, it is always
predicted. Languages outside ``FAMILIES`` are families of their own. Equal texts get equal answers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsegrain.llm.common import fresh, shared, small_batches

SIZE = 2048
SAMPLE = 6000
UNKNOWN = "und"
# Language codes by family.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "turkic": "az kk ky tr tt uz",
    "uralic": "et fi hu",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
KEPT = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
PREDICTED = "lang string, score double"
FITTED = "machine int, langs array<string>, weights binary"


def features(text: str) -> np.ndarray:
    data = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(KEPT).split()) + b" ", np.uint8).astype(np.uint32)
    pairs = data[:-1] * np.uint32(0x9E3779B1) + data[1:] * np.uint32(0x85EBCA77)
    triples = pairs[:-1] * np.uint32(3) + data[2:] * np.uint32(0xC2B2AE3D) + np.uint32(7)
    cells = np.concatenate([pairs, triples])
    cells ^= cells >> np.uint32(15)
    counts = np.sqrt(np.bincount((cells * np.uint32(0x27D4EB2F)) >> np.uint32(21), minlength=SIZE)).astype(np.float32)
    return counts / max(float(np.linalg.norm(counts)), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, steps: int = 400) -> np.ndarray:
    """Weights (bias last) by accelerated descent on the squared hinge; both classes weigh the same."""
    return descend(np.column_stack([x, np.ones(len(x), np.float32)]), y, strength, steps)


def descend(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, steps: int = 400) -> np.ndarray:
    """``fit_svm`` of rows that end in a 1."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, v = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for i in range(steps):
        gap = np.maximum(0, 1 - y * (x @ v)) * share
        new = v - 0.2 * (strength * v - 2 * (x.T @ (gap * y)))
        v, w = new + i / (i + 3) * (new - w), new
    return w


def by_family(langs: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for code in sorted(langs):
        out.setdefault(FAMILY_OF.get(code, code), []).append(code)
    return out


@dataclass
class Model:
    families: list[str]
    members: dict[str, list[str]]
    outer: np.ndarray  # one row a family
    inner: dict[tuple[str, str], np.ndarray]

    @classmethod
    def of(cls, known: list[str], weights: dict[tuple[str, ...], np.ndarray]) -> Model:
        """``known``: the languages in the sample. ``weights``: of a family, or of two languages of one, where both sides had rows."""
        members = by_family(known)
        names = sorted(members)
        inner = {(a, b): weights[a, b] for group in members.values() for i, a in enumerate(group) for b in group[i + 1:]}
        return cls(names, members, np.array([weights[f,] for f in names] if len(names) > 1 else []), inner)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0
        x = np.append(features(text), np.float32(1))
        chance = lambda margin: float(1 / (1 + np.exp(-3 * margin)))
        family, score = self.families[0], 1.0
        if len(self.families) > 1:
            margins = self.outer @ x
            best = int(margins.argmax())
            family, score = self.families[best], chance(margins[best])
        group = self.members[family]
        votes, sums = dict.fromkeys(group, 0), dict.fromkeys(group, 0.0)
        against = dict.fromkeys(group, 1.0)
        for i, a in enumerate(group):
            for b in group[i + 1:]:
                margin = float(self.inner[a, b] @ x)
                votes[a if margin >= 0 else b] += 1
                for code, own in ((a, margin), (b, -margin)):
                    sums[code] += own
                    against[code] = min(against[code], chance(own))
        lang = max(group, key=lambda code: (votes[code], sums[code]))
        return lang, score * against[lang]


def learn(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Fit on a bounded sample of the rows given; only their text and language are looked at."""
    rows = labelled.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where(
        "text is not null and lang is not null and id is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not counts:
        return None
    share = sample / len(counts)
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    take = F.element_at(F.create_map(*(F.lit(v) for code, n in counts.items() for v in (code, share / n))), F.col("lang"))

    def count(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()).astype(np.float16).tobytes() for t in texts], pa.binary())

    drawn = rows.where(draw < take).select(F.col("id").cast("string").alias("id"), "lang", draw.alias("draw"), F.arrow_udf(count, "binary")("text").alias("x"))
    # Where ids repeat the draw may hold more than the sample: the same first ones stay on every run.
    return _fitted(drawn.orderBy("draw", "lang", "x").limit(2 * sample + 100).drop("draw"), list(counts))


def _fitted(drawn: DataFrame, langs: list[str]) -> Model | None:
    """The machines between ``langs``, each from those rows (id, lang, x) that lie on one of its sides."""
    members = by_family(langs)
    sides = [((f,), {code: 1 if code in members[f] else -1 for code in langs}) for f in members]
    sides += [((a, b), {a: 1, b: -1}) for group in members.values() for i, a in enumerate(group) for b in group[i + 1:]]
    dealt = drawn.sparkSession.createDataFrame(
        [(code, machine, side) for machine, (_, of) in enumerate(sides) for code, side in of.items()], "code string, machine int, side int")

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("id", "ascending"), ("x", "ascending"), ("lang", "ascending")])
        y, weights = rows["side"].to_numpy().astype(np.float32), None
        if len(np.unique(y)) > 1:
            x = np.ones((len(y), SIZE + 1), np.float32)
            for i, cells in enumerate(rows["x"]):
                x[i, :SIZE] = np.frombuffer(cells.as_buffer(), np.float16)
            weights = descend(x, y).tobytes()
        return pa.table([rows["machine"][:1], pa.array([rows["lang"].unique().to_pylist()], pa.list_(pa.string())),
                         pa.array([weights], pa.binary())], names=["machine", "langs", "weights"])

    with small_batches(drawn.sparkSession):
        rows = drawn.join(F.broadcast(dealt), F.col("lang") == F.col("code")).drop("code")
        made = rows.groupBy("machine").applyInArrow(fit, FITTED).collect()  # a machine's weights are 8 KB
    # All rows take part in each family's machine, so any of these has seen every language.
    known = {code for r in made for code in r.langs}
    weights = {sides[r.machine][0]: np.frombuffer(r.weights, np.float32) for r in made if r.weights is not None}
    return Model.of(sorted(known), weights) if known else None


def predict(docs: DataFrame, model: Model | None, predicted: str = "predicted", text: str = "text") -> DataFrame:
    """``docs`` with a struct column (lang, score)."""
    known = shared(docs.sparkSession, model)

    def tell(texts: pa.Array) -> pa.Array:
        model = known()
        rows = [model.predict(t.as_py()) if model else (UNKNOWN, 0.0) for t in texts]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], names=["lang", "score"])

    return docs.withColumn(predicted, F.arrow_udf(tell, PREDICTED)(F.col(f"`{text}`")))


def keep_identified(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The documents whose language was recognised, with their own columns."""
    name = fresh(docs, "predicted")
    return predict(docs, model, name, text).where(F.col(f"`{name}`.lang") != UNKNOWN).drop(name)
