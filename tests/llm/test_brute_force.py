"""Operators without SQL, and the pipeline, against plain loops."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrain.llm import language_id, mixing, toxicity, training_order
from pulsegrain.session import work_dir
from tests.llm.test_operators import frame


def test_the_family_is_chosen_first_and_then_its_languages_vote():
    draw = np.random.default_rng(5)
    members = {"f": ["a", "b", "c"], "g": ["d", "e"], "h": ["x"]}
    size = language_id.SIZE
    for _ in range(40):
        outer = draw.normal(size=(3, size + 1))
        inner = {pair: draw.normal(size=size + 1) for group in members.values() for pair in itertools.combinations(group, 2)}
        model = language_id.Model(list(members), members, outer, inner)
        text = "".join(draw.choice(list("abcdefgh ")) for _ in range(60)) + "z"
        x = np.append(language_id.features(text), np.float32(1))
        family = max(zip(outer @ x, members))[1]
        wins, sums = {c: 0 for c in members[family]}, {c: 0.0 for c in members[family]}
        for a, b in itertools.permutations(members[family], 2):
            margin = float(inner[a, b] @ x) if (a, b) in inner else -float(inner[b, a] @ x)
            wins[a] += margin > 0
            sums[a] += margin
        wanted = max(members[family], key=lambda c: (wins[c], sums[c]))
        lang, score = model.predict(text)
        assert lang == wanted and 0 <= score <= 1
    assert model.predict(None) == model.predict("12 !?") == ("und", 0.0)


def test_one_against_one_separates_what_can_be_separated():
    draw = np.random.default_rng(6)
    x = draw.normal(size=(200, 10)).astype(np.float32)
    y = np.where(x @ np.arange(1, 11) > 0, 1, -1).astype(np.float32)
    w = language_id.fit_svm(x, y)
    assert (np.sign(np.column_stack([x, np.ones(200)]) @ w) == y).mean() > 0.97


def test_features_are_plain_counts():
    learned = {"=grub": 2.0, "grub": 1.0, "snot": 1.5}
    text = "You IDIOT! you are a st0pid grub, snotty LOSER... ok U a b c d e f g h trash"
    got = dict(zip(toxicity.NAMES, toxicity.Measurer(learned).measure(text)))
    words = text.split()
    assert got["words"] == len(words)
    plain = [re.sub(r"^[\W_]+|[\W_]+$", "", w).lower() for w in words]
    insults = [i for i, (w, p) in enumerate(zip(words, plain)) if p in toxicity.INSULTS or re.sub(r"^[\W_]+|[\W_]+$", "", w.translate(toxicity.SIGNS)).lower() in toxicity.INSULTS]
    second = [i for i, p in enumerate(plain) if p in toxicity.SECOND]
    marked = [i for i, p in enumerate(plain) if p == "grub" or p.startswith("snot")]
    assert (got["insults"], got["insult_share"]) == (len(insults), len(insults) / len(words))
    assert (got["learned"], got["learned_kinds"], got["learned_top"], got["learned_sum"]) == (2, 2, 2.0, 3.5 / len(words))
    assert got["near_second"] == sum(any(abs(i - j) <= 5 for j in second) for i in {*insults, *marked})
    assert got["second_share"] == len(second) / len(words) and got["capital_share"] == sum(c.isupper() for c in text) / len(text)
    assert got["shout_share"] == sum(len(p) > 2 and w.isupper() for w, p in zip(words, plain)) / len(words)
    assert got["exclaim_share"] == text.count("!") / len(text)
    assert toxicity.Measurer(learned).measure(None) == toxicity.Measurer(learned).measure(" ") == [0.0] * len(toxicity.NAMES)


def test_scores_rise_with_the_share_of_toxic_rows(spark):
    """Calibration is monotone: what the trees call more toxic is not called less so afterwards."""
    draw = random.Random(3)
    rows, marks = [], []
    for i in range(400):
        bad = draw.random() < 0.5
        words = [draw.choice(["plain", "word", "here", "you"]) for _ in range(30)]
        for _ in range(draw.randint(2, 5) if bad else draw.randint(0, 1)):
            words[draw.randrange(30)] = draw.choice(["idiot", "moron"])
        rows.append(" ".join(words))
        marks.append((i, int(bad)))
    out = toxicity.score(frame(spark, [*rows, None, ""]), spark.createDataFrame(marks, "doc_id bigint, toxic int"), F.col("id") % 5 != 0, F.col("id") % 5 == 4)
    scores = {r.doc_id: r.score for r in out.collect()}
    assert len(scores) == 402 and all(0 <= s <= 1 for s in scores.values())
    held = [(scores[i], bad) for i, bad in marks if i % 5 == 0]
    means = [sum(s for s, bad in held if bad == label) / sum(bad == label for _, bad in held) for label in (0, 1)]
    assert means[1] - means[0] > 0.5
    by_insults = {}
    for i, text in enumerate(rows):
        by_insults.setdefault(min(sum(w in ("idiot", "moron") for w in text.split()), 3), []).append(scores[i])
    means = [sum(v) / len(v) for _, v in sorted(by_insults.items())]
    assert means == sorted(means)


def test_every_document_keeps_its_tokens_in_order(spark):
    import tiktoken
    draw = random.Random(9)
    texts = [" ".join(draw.choice(["alpha", "beta", "¿qué?", "\n", "x1"]) for _ in range(draw.randint(0, 80))) for _ in range(150)] + [None, ""]
    folder, layout = work_dir(spark, "shards"), training_order.Layout(length=16, per_shard=40)
    index = {r.slot: r for r in training_order.materialise(frame(spark, texts).repartition(3, "doc_id"), folder, layout).collect()}
    records = list(training_order.read_from(folder))
    slots = training_order.permute(np.arange(len(records)), len(records), layout.key)
    stream, owners = [], []
    for slot in slots:  # in the order in which the tasks cut them
        stream += records[slot][:index[slot].n_tokens].tolist()
        for d in index[slot].doc_ids:
            if not owners or owners[-1] != d:
                owners.append(d)
    coder = tiktoken.Encoding("own", pat_str=training_order.SPLIT, mergeable_ranks=training_order.load_ranks(), special_tokens={})
    found, own = {}, []
    for token in stream:
        own.append(token)
        if token == layout.end:
            found[owners[len(found)]], own = own, []
    assert found == {i: [*coder.encode_ordinary(t or ""), layout.end] for i, t in enumerate(texts)} and not own


def test_the_mix_is_plain_pareto_ranking(spark):
    draw = random.Random(12)
    texts = ["w " * int(draw.paretovariate(1) * 8) for _ in range(700)] + [None]
    sources = {i: ("a", "b", "c", None)[i % 4 if i > 300 else 0] for i in range(701)}
    names = {k: f"m_{k}" for k in ("size", "source_size", "target", "copies")}
    got = {r.doc_id: r.m_copies for r in mixing.with_copies(frame(spark, texts, sources), names).collect()}
    size = [len((t or "").split()) for t in texts]
    totals = {s: sum(size[i] for i in sources if sources[i] == s) for s in ("a", "b", "c", None)}
    goal = mixing.targets(totals, {"a": 1, "b": 2, "c": 3, None: 1}, 3.0)
    for s, total in totals.items():
        own = [i for i in sources if sources[i] == s]
        heavy = {i: math.ceil(math.sqrt(size[i])) for i in own}
        mean, ratio = sum(size[i] * heavy[i] for i in own) / total, goal[s] / total
        rise = max(heavy.values()) / mean - 1
        spread = max(0.0, min(1.0, (3 / ratio - 1) / rise)) if rise > 0 else 0.0
        chance = {i: max(0.0, min(3.0, ratio * (1 + spread * (heavy[i] / mean - 1)))) for i in own}
        copies = {i: math.floor(chance[i]) for i in own}
        rest, order = goal[s] - sum(copies[i] * size[i] for i in own), []
        for i in own:
            p = chance[i] - math.floor(chance[i])
            u = (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            if p > 0:
                order.append((u * (1 - p) / (u * (1 - p) + p * (1 - u)), i))
        order.sort()
        while order and size[order[0][1]] <= rest:
            rest -= size[order[0][1]]
            copies[order.pop(0)[1]] += 1
        near = [(abs(size[i] - rest), q, i) for q, i in order if abs(size[i] - rest) < rest]
        if near:
            copies[min(near)[2]] += 1
        assert {i: got[i] for i in own} == copies


WORDS = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]


def test_the_pipeline_on_odd_rows(spark, tmp_path):
    draw = random.Random(2)
    base = draw.sample(WORDS, 60)
    near = [*base[:30], "changed", *base[31:]]
    passage = draw.sample(WORDS, 25)
    texts = {1: None, 2: "", 3: "123 !!! 45", 4: " ".join(base), 5: " ".join(base), 6: " ".join(near), 7: "clean words of one kind stay here",
             8: "before it " + " ".join(passage) + " after it", 9: "ein kurzer Text", 10: "word " * 30_000, 11: "WORD " * 30_000}
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, uid string, found int, _size string"
    rows = [(i, t, "de" if i == 9 else "en", None if i == 7 else "ab"[i % 2], 1, "u", 2, "s") for i, t in texts.items()]
    rows += [(None, "no id but words", "en", "a", 1, "u", 2, "s"), (7, texts[7], "en", None, 1, "u", 2, "s")]
    sf = str(tmp_path)
    spark.createDataFrame([("i1", " ".join(passage)), ("i2", None), (None, "")], "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
    kept, docs = {}, spark.createDataFrame(rows, kind)
    docs.write.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        path = work_dir(spark, f"stage-{name}")
        out.write.parquet(path)
        docs, before = spark.read.schema(out.schema).parquet(path), docs
        if name != "token_shards":
            assert docs.columns == before.columns
            kept[name] = sorted((r.doc_id for r in docs.collect()), key=str)
    by = lambda *ids: sorted(ids, key=str)
    assert kept["language_id"] == by(4, 5, 6, 7, 7, 8, 9, 10, 11, None)
    assert kept["near_duplicates"] == by(4, 7, 8, 9, 10, None)
    assert kept["decontamination"] == by(4, 7, 9, 10, None)
    assert set(kept["source_mix"]) <= set(kept["decontamination"]) and kept["source_mix"]
    assert {d for r in docs.collect() for d in r.doc_ids} == set(kept["source_mix"])
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_the_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
