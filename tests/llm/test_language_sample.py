"""The language model is fitted in a task: the driver gets weights, not the sample, and they are those of a plain fit."""

import random

import numpy as np

from pulsegrain.llm import language_id

WORDS = {"de": "der und nicht eine über straße haus mädchen", "en": "the and not house street girl over with",
         "fr": "le et pas une maison rue fille être", "es": "el y no una casa calle niña sobre", "xx": "qa zu wek lomi"}


def documents(spark, langs, n):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randrange(3, 30))), lang) for i, lang in enumerate(rng.choices(langs, k=n))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)


def test_the_driver_gets_weights_only(spark, monkeypatch):
    rows, docs = documents(spark, list(WORDS), 300)
    got, kind = [], type(docs)
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: got.append(collect(self)) or got[-1])
    model = language_id.learn(docs)
    assert max(map(len, got)) <= 5  # languages, then machines; the 300 rows of the sample came before
    rows.sort(key=lambda r: str(r[0]))
    x = np.array([language_id.features(text).astype(np.float16) for _, text, _ in rows], np.float32)
    langs = np.array([lang for _, _, lang in rows])
    assert model.families == ["germanic", "romance", "xx"]
    assert model.members == {"germanic": ["de", "en"], "romance": ["es", "fr"], "xx": ["xx"]}
    for f, weights in zip(model.families, model.outer, strict=True):
        assert np.allclose(weights, language_id.fit_svm(x, np.where(np.isin(langs, model.members[f]), 1, -1).astype(np.float32)), atol=1e-3)
    assert sorted(model.inner) == [("de", "en"), ("es", "fr")]
    for (a, b), weights in model.inner.items():
        own = (langs == a) | (langs == b)
        assert np.allclose(weights, language_id.fit_svm(x[own], np.where(langs[own] == a, 1, -1).astype(np.float32)), atol=1e-3)


def test_one_family_and_one_language(spark):
    rows, docs = documents(spark, ["de", "en"], 40)
    model = language_id.learn(docs)
    assert len(model.outer) == 0 and list(model.inner) == [("de", "en")] and {model.predict(t)[0] for _, t, _ in rows} == {"de", "en"}
    model = language_id.learn(docs.where("lang = 'de'"))
    assert len(model.outer) == 0 and not model.inner and {model.predict(t)[0] for _, t, _ in rows} == {"de"}
    assert language_id.learn(docs.where("lang is null")) is None


def test_languages_the_draw_misses_are_unknown(spark):
    rows, docs = documents(spark, ["de", "en", "fr"], 60)
    draws = {r.doc_id: r.draw for r in docs.selectExpr("doc_id", "pmod(xxhash64(string(doc_id)), 1099511627776L) / 1099511627776D AS draw").collect()}
    often = {code: sum(lang == code for _, _, lang in rows) for code in ("de", "en", "fr")}
    for sample in (0, 1, 2, 4, 60):
        drawn = {lang for i, _, lang in rows if draws[i] < sample / 3 / often[lang]}
        model = language_id.learn(docs, sample=sample)
        assert drawn == ({c for group in model.members.values() for c in group} if model else set())
        assert model is None or len(model.outer) == (len(model.families) if len(model.families) > 1 else 0)
