"""The training-data operators against brute force, and their defined edge cases, on small hand-made rows."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrain.llm import (decontaminate, exact_dedup, language_id, mixing, near_dup, queries, secret_scan, token_count,
                            toxicity, training_order, url_filter)
from pulsegrain.session import work_dir

KIND = "doc_id bigint, text string, lang string, source string, _mix_size string, FOUND string"


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, "a"), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs, empty and long texts, repeated rows, clashing column names."""
    long = "word " * 20_000 + "tail end"
    return spark.createDataFrame([(1, None, None, None, None, "y"), (2, "", "en", "a", "x", "y"), (3, long, "en", "a", "x", None),
                                  (4, "same text here", "de", "b", "x", "y"), (4, "same text here", "de", "b", "x", "y"),
                                  (None, "same text here", "fr", None, "x", "y"), (6, "123 456 !!!", "en", "b", "x", "y")], KIND)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def test_exact_dedup_over_two_batches(spark):
    index = exact_dedup.DigestIndex(spark, work_dir(spark, "index"), buckets=3)
    first = {r.doc_id: r for r in index.admit(frame(spark, ["a", "b", "a", None, ""])).collect()}
    assert [first[i].keep_id for i in range(5)] == [2, 1, 2, 4, 4] and first[0].group_size == 2
    again = index.admit(spark.createDataFrame([(9, "a", ""), (8, "new", "")], "doc_id bigint, text string, digest string")).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in again} == {(9, 2, False), (8, 8, True)}
    assert index.read().count() == 4


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://com", "http://WWW.Example.com/en/x?q#f", "http://example.com/en/", "http://notexample.com/en/",
            "x://a.net/es/1", "x://a.net/fr", "x://buy.cheap-pills.org/", "x://ads1.shop.org/", "x://a.org/wp-login.php", "x://a.org/p?x=/wp-login.php"]
    rows = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id int, url string, verdict string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.judge_urls(rows, queries.URL_RULES).collect()}
    assert got[0] == ("", None, "allow") and got[3] == ("com", None, "allow")
    assert got[4] == ("www.example.com", "www.example.com/en/", "allow") and got[5][1:] == ("example.com/en/", "block")
    assert got[6][1:] == ("com/", "allow") and got[7][1:] == ("net/es/", "block") and got[8][1:] == (None, "allow")
    assert [got[i][2] for i in (9, 10, 11, 12)] == ["block", "block", "block", "allow"]


def brute_windows(text, items, width):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    doc, hit, named = words(text), set(), set()
    for name, body in items:
        own = words(body)
        n = min(width, len(own))
        wins = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if n else set()
        for p in range(len(doc) - n + 1):
            if tuple(doc[p:p + n]) in wins:
                hit |= set(range(p, p + n))
                named.add(name)
    return len(doc), len(hit), sorted(named)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination_matches_brute_force(spark, block_bytes):
    draw = random.Random(3)
    make = lambda n: " ".join(draw.choice(["a", "b", "C", "é", "d1"]) for _ in range(n))
    items = [(str(i), make(draw.randint(0, 9))) for i in range(8)] + [("9", None)]
    texts = [make(draw.randint(0, 60)) for _ in range(60)] + [None, ""]
    out = decontaminate.find_matches(frame(spark, texts), spark.createDataFrame(items, "item_id string, text string"), "hits", width=4, block_bytes=block_bytes)
    for r in out.collect():
        assert (r.hits.n_words, r.hits.n_hit, sorted(r.hits["items"])) == brute_windows(texts[r.doc_id], items, 4)


def test_longest_match_and_removal(spark):
    text = " ".join(f"w{i}" for i in range(40))
    item = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(10, 25)))], "item_id int, text string")
    docs = frame(spark, ["x " + text, "clean words only"])
    match = decontaminate.find_matches(docs, item).where("doc_id = 0").first().found.matches
    assert [(m["item"], m.doc_word, m.item_word, m.n_words) for m in match] == [("7", 11, 0, 15)]
    kept = decontaminate.decontaminate(docs, item)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def test_near_duplicates_match_brute_force(spark):
    draw = random.Random(5)
    bases = [[draw.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(draw.randint(1, 40))] for _ in range(12)]
    texts = [None, "", "one", "ONE"]
    for base in bases:
        for _ in range(8):
            words = list(base)
            for _ in range(draw.randint(0, 4)):
                words[draw.randrange(len(words))] = draw.choice("ABCDEFG") * 3
            texts.append(" ".join(words))
    assert_classes(spark, texts, large=3)


def test_large_group_of_near_copies_matches_brute_force(spark):
    """Copies of one text with up to 14 changed words, some with the same changes, in buckets above ``large``."""
    draw = random.Random(8)
    base, twin = ([f"{kind}{i}" for i in range(60)] for kind in "wv")
    texts = []
    for i in range(240):
        words = list(base if i % 5 else twin[:20] + base[20:])
        for _ in range(draw.randint(0, 14)):
            words[draw.randrange(60)] = draw.choice("abcdefgh") if i % 3 else f"own{draw.random()}"
        texts.append(" ".join(words))
        if i % 20 == 7:
            texts += [" ".join([*words[:50], f"end{i}", str(j), "x"]) for j in range(3)]
    assert_classes(spark, texts, large=4)


def assert_classes(spark, texts, large):
    sets = []
    for t in texts:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        sets.append({tuple(words[i:i + 2]) for i in range(max(1, len(words) - 1))} if words else set())
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b)]
    label, before = list(range(len(texts))), None
    while label != before:
        before = list(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    got = near_dup.classes(frame(spark, texts), near_dup.Settings(words=2, large=large)).collect()
    assert {r.row.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), label[i]) for i, s in enumerate(sets)}


def test_secrets_match_regular_expressions(spark):
    draw = random.Random(1)
    parts = ["token", "=", ":", " ", "abc", "passwd", "é", "\n", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "'", "api_key", "APIkey", "secret", "deadbeef", "\"", ",", "中"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 40))) for _ in range(800)] + [None, "token=token: abcdef", "x" * 30_000 + "AKIA" + "A" * 16]
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in secret_scan.find_secrets(frame(spark, texts)).collect():
        t = texts[r.doc_id] or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        kinds = [k.kind for k in secret_scan.BASE]
        assert [(s.start, kinds.index(s.kind), s.end) for s in r.spans if s.kind in kinds] == sorted(want)


def test_token_counts_match_the_public_tokenizer():
    from tokenizers import Tokenizer, models, pre_tokenizers
    pieces = token_count.load_pieces()
    vocabulary = [("<unk>", 0.0), *pieces, *((f"<0x{b:02X}>", 0.0) for b in range(256))]
    public = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    public.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_count.MARK, prepend_scheme="always", split=True)
    draw, counter = random.Random(2), token_count.Counter(pieces)
    texts = ["", " ", "  a", "a  b ", "中文字 😀😀 x", "▁a ▁", "\n\n", "a\tb"]
    texts += ["".join(draw.choices(["a", "the", " ", "é", "😀", "中", "\n", "▁", "ing", "s", "0"], k=30)) for _ in range(500)]
    assert [counter.text(t) for t in texts] == [len(public.encode(t, add_special_tokens=False).ids) for t in texts]


def test_slots_are_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        slots = training_order.permute(np.arange(n), n, "k")
        assert sorted(slots.tolist()) == list(range(n))
    assert (training_order.permute(np.arange(1000), 1000, "k") != training_order.permute(np.arange(1000), 1000, "l")).any()


def test_shards_hold_every_token_and_resume(spark):
    texts = [f"text number {i} " * (i % 50) for i in range(120)] + [None]
    folder = work_dir(spark, "shards")
    layout = training_order.Layout(length=16, per_shard=50)
    index = {r.slot: r for r in training_order.materialise(frame(spark, texts).repartition(3), folder, layout).collect()}
    records = list(training_order.read_from(folder))
    assert sorted(index) == list(range(len(records)))
    assert all(zlib.crc32(r.tobytes()) == index[i].crc for i, r in enumerate(records))
    assert [r.tolist() for r in training_order.read_from(folder, 77, 60)] == [r.tolist() for r in records[77:137]]
    import tiktoken
    coder = tiktoken.Encoding("own", pat_str=training_order.SPLIT, mergeable_ranks=training_order.load_ranks(), special_tokens={})
    want = sorted(t for x in texts for t in [*coder.encode_ordinary(x or ""), layout.end])
    assert sorted(int(t) for i, r in enumerate(records) for t in r[:index[i].n_tokens]) == want
    assert {d for r in index.values() for d in r.doc_ids} == set(range(len(texts)))


def test_targets_and_mix(spark):
    assert mixing.targets({"a": 10, "b": 1000, "c": 10}, {"a": 1, "b": 1, "c": 2}, 3.0) == pytest.approx({"a": 30, "b": 960, "c": 30})
    draw = random.Random(4)
    sources = {i: ("a", "b", None)[i % 3] if i > 200 else "a" for i in range(900)}
    docs = frame(spark, ["w " * draw.randint(0, 60) for _ in range(900)], sources)
    names = {k: f"m_{k}" for k in ("size", "source_size", "target", "copies")}
    rows = mixing.with_copies(docs, names).orderBy("doc_id").collect()
    assert rows == mixing.with_copies(docs, names).orderBy("doc_id").collect()
    for source in {"a", "b", None}:
        own = [r for r in rows if r.source == source]
        assert sum(r.m_size * r.m_copies for r in own) == pytest.approx(own[0].m_target, rel=0.02)
        assert max(r.m_copies for r in own) <= 3
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(docs).count() == sum(r.m_copies for r in rows)


def test_language_and_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in queries.op1_language_id(spark, sf).collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held) > 0
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op3_toxicity(spark, sf).collect() if r.held_out and r.doc_id in toxic]
    assert sum(toxic[r.doc_id] == r.predicted for r in rows) >= 0.9 * len(rows) > 0


def test_odd_rows(spark, odd, empty):
    benchmark = spark.createDataFrame([(None, None), ("i", "")], "item_id string, text string")
    for docs, n in ((odd, 7), (empty, 0)):
        model = language_id.learn(docs)
        assert language_id.predict(docs, model).count() == n
        assert decontaminate.find_matches(docs, benchmark).count() == n and decontaminate.decontaminate(docs, benchmark).count() == n
        assert near_dup.classes(docs).count() == n
        assert secret_scan.find_secrets(docs).count() == n and token_count.count_tokens(docs, [("▁", 0.0), ("a", -1.0)]).count() == n
        assert exact_dedup.DigestIndex(spark, work_dir(spark, "index"), buckets=2).admit(docs).count() == n
        assert mixing.with_copies(docs, {k: f"m_{k}" for k in ("size", "source_size", "target", "copies")}).count() == n
        assert sum(r.n_tokens for r in training_order.materialise(docs, work_dir(spark, "shards"), training_order.Layout(length=64)).collect()) >= n
        labels = docs.selectExpr("doc_id", "cast(null as int) as toxic")
        assert toxicity.score(docs, labels, F.lit(True), F.lit(False)).count() == n
    assert {r["row"].doc_id for r in near_dup.classes(odd).collect() if r.keeper and r["row"].text == "same text here"} == {4}
    assert language_id.predict(odd, language_id.learn(odd)).where("doc_id = 6").first().predicted.lang == "und"
