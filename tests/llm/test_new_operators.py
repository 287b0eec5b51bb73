"""Packing, hard negatives and the prefix trie against brute force, on odd rows and over several rounds."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulsegrain.llm import hard_negatives, packing, prefix_trie

DOCS = "doc_id bigint, text string, sequence_id string, `offset` int, _bin int"


# --- packing ---

def check_packing(rows, capacity, size="length"):
    """No gaps, no overlap, nothing too long; returns the number of sequences."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r[size]))
    for of in held.values():
        end = 0
        for at, n in sorted(of):
            assert at == end
            end += n
        assert end <= capacity
    return len(held)


def test_ids_are_those_of_the_tokenizers_library_for_every_code_point():
    ranks, special = packing.load_vocabulary()
    coder = tiktoken.Encoding("own", pat_str=packing.SPLIT, mergeable_ranks=ranks, special_tokens=special)
    other = Tokenizer.from_file(packing.VOCABULARY)
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a{chr(i)}b {chr(i)}1{chr(i)}.{chr(i)} \n{chr(i)}{chr(i)} x" for i in points[at:at + 64]) for at in range(0, len(points), 64)]
    rng, tokens = random.Random(1), list(ranks)
    texts += [b"".join(rng.choices(tokens, k=rng.randrange(1, 12))).decode("utf-8", "ignore") for _ in range(20000)]
    texts += ["", "<|endoftext|>", "a<|endoftext|> b", "x" * 5000]
    for text, made in zip(texts, other.encode_batch_fast(texts, add_special_tokens=False)):
        assert coder.encode_to_numpy(text, allowed_special="all").tolist() == made.ids


def test_pieces_hold_the_whole_texts(spark):
    coder = Tokenizer.from_file(packing.VOCABULARY)
    texts = [None, "", "short", "short", "word " * 300, "a b c d e f g " * 150, "é" * 3000, "<|endoftext|>"]
    docs = spark.createDataFrame([(i if i != 2 else None, t, "s", 1, 1) for i, t in enumerate(texts)], DOCS)
    pieces = packing.cut(docs, capacity=100)
    whole = defaultdict(list)
    for r in pieces.orderBy("key").collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length <= 100 and r.start == len(whole[r.doc_id]) and (r.piece == 0 or r.length == 100)
        whole[r.doc_id] += ids
    expected = {i if i != 2 else None: [*coder.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert whole == expected
    packed = packing.pack(pieces, capacity=100)
    assert packed.columns == ["key", "doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    check_packing(packed.collect(), 100)
    assert packing.cut(docs.limit(0)).count() == 0


def test_best_fit_is_the_plain_one():
    rng = random.Random(3)
    for _ in range(50):
        sizes = [rng.randrange(0, 33) for _ in range(rng.randrange(0, 80))]
        rooms = []
        for s in sorted(sizes, reverse=True):
            fitting = [i for i, r in enumerate(rooms) if r >= s and r > 0]
            if fitting:
                rooms[min(fitting, key=lambda i: rooms[i])] -= s
            else:
                rooms.append(32 - s)
        where, place, fills = packing.best_fit(np.array(sizes, np.int32), 32)
        assert sorted(fills.tolist()) == sorted(32 - r for r in rooms)
        assert all(sum(s for s, w in zip(sizes, where) if w == b) == f for b, f in enumerate(fills))


@pytest.mark.parametrize("per_task", [100, 1000, 100000])
def test_rounds_come_near_the_least_number(spark, per_task):
    rng = random.Random(5)
    sizes = [rng.choice([rng.randrange(1, 1025), rng.randrange(1, 300)]) for _ in range(6000)]
    rows = spark.createDataFrame([(i, s, 0, "x") for i, s in enumerate(sizes)], "n int, length int, `offset` int, _place string")
    out = packing.pack(rows, per_task=per_task).collect()
    assert sorted(r.n for r in out) == list(range(6000)) and out[0]._place == "x"
    assert check_packing(out, 1024) <= 1.02 * math.ceil(sum(sizes) / 1024)


def test_rows_that_never_fit_together_end(spark):
    rows = spark.range(3000).select(F.lit(600).alias("length"))
    assert check_packing(packing.pack(rows, per_task=50).collect(), 1024) == 3000
    zero = spark.range(500).select(F.lit(0).alias("length"))
    check_packing(packing.pack(zero, per_task=50).collect(), 1024)
    assert packing.pack(rows.limit(0)).collect() == []
    with pytest.raises(Exception, match="sizes must be"):
        packing.pack(spark.range(3).select(F.lit(2000).alias("length"))).collect()


# --- hard negatives ---

def plain_negatives(rows, s):
    usable = [(i, [math.floor(s.scale * x) for x in v], lab) for i, v, lab in rows
              if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    first = lambda found: sorted(found, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    out = []
    for n, (i, q, lab) in enumerate(usable):
        if i is None or i % 5:
            continue
        scored = [(j, dot(q, p), other) for m, (j, p, other) in enumerate(usable) if m != n]
        for j, best, _ in first([r for r in scored if r[2] == lab])[:s.positives]:
            inside = [r for r in scored if r[2] != lab and s.low * best <= 100 * r[1] <= s.high * best]
            out += [(i, j, k + 1, r[0], best, r[1]) for k, r in enumerate(first(inside)[:s.negatives])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("settings", [hard_negatives.Settings(), hard_negatives.Settings(anchors=3), hard_negatives.Settings(scale=1 << 24),
                                      hard_negatives.Settings(scale=3, low=0, high=100)])
def test_hard_negatives_are_those_of_brute_force(spark, settings):
    rng = random.Random(7)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.5))) for _ in range(rng.choice([11, 11, 11, 8, 3]))], rng.randrange(3)) for i in range(150)]
    rows += [(i % 50, rows[i][1], rows[i][2]) for i in range(100, 120)]  # repeated ids, copies of vectors
    rows += [rows[5], rows[10], rows[10], (None, rows[10][1], 1), (None, rows[11][1], 2), (200, rows[10][1], 0)]
    rows += [(300, [], 1), (305, None, 1), (310, [1.0, None], 1), (315, [1.0, float("nan")], 2), (320, [float("inf")], 2), (325, [1.0], None)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, id string").repartition(5)
    out = hard_negatives.mine(frame, F.col("id") % 5 == 0, settings)
    assert sorted(map(tuple, out.collect()), key=repr) == plain_negatives(rows, settings)


def test_hard_negatives_of_empty_and_too_large_input(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert hard_negatives.mine(none, F.lit(True)).collect() == []
    large = spark.createDataFrame([(0, [1e30], 1)], none.schema)
    with pytest.raises(Exception, match="below 2"):
        hard_negatives.mine(large, F.lit(True)).collect()


def test_lookups_give_the_inner_products():
    rng = np.random.default_rng(1)
    for low, high, dims in ((-5, 6, 8), (-1, 0, 16), (0, 1, 24), (-2000, 1999, 64), (0, 0, 8)):
        a, b = rng.integers(low, high + 1, (7, dims)), rng.integers(low, high + 1, (40, dims))
        planes = hard_negatives.bit_planes(b)
        assert np.array_equal(hard_negatives.scores(hard_negatives.subset_sums(a, dims // 8), planes), b @ a.T)


# --- prefix trie ---

def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[-1] for t in sorted(of)] for c, of in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, of in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = own.get(c - int(math.fmod(c, 5)), [])[:h] + of[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    saved = {p: (len(m) - 1) * len(p[-1][1].encode()) if p else 0 for p, m in members.items()}
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, total = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            total[p[:d]] += saved[p]
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], total[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()), key=repr)


def trie_of(spark, rows, per_task):
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, pos int")
    turns = prefix_trie.numbered(prefix_trie.turn_keys(frame))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    out = prefix_trie.prefix_trie(*prefix_trie.rebuilt(turns, F.col("conv_id") - F.col("conv_id") % 5, shared, 8), per_task)
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("per_task", [1, 40, 10000])
def test_the_trie_is_that_of_brute_force(spark, per_task):
    rng = random.Random(11)
    rows = [(c, t, rng.choice(["user", "user", None]), rng.choice(["a", "b", "é" * 5, None, ""])) for c in range(-12, 60) for t in range(rng.randrange(0, 14))]
    rows += [(7, None, "user", "first"), (7, None, "user", "again"), (7, 3, "user", "a"), (7, 3, "user", "a"), (None, 1, "user", "lost")]
    rows += [(c, t, "user", "same") for c in range(100, 130) for t in range(6)]
    assert trie_of(spark, rows, per_task) == plain_trie(rows)


def test_a_very_long_conversation_spans_tasks_and_slices(spark):
    n = 2 * prefix_trie.SLICE + 300
    rows = [(c, t, "user", f"{t}" if t < n - c else f"{c} {t}") for c in (1, 2, 3) for t in range(n)] + [(4, 0, "user", "x" * 100000)]
    made, mark = trie_of(spark, rows, 500), hashlib.sha256
    at = {(r[0], r[1]): r for r in made}
    paths = {}
    for c in (1, 2, 3, 4):
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = [t[3] for t in rows if t[0] == c][h:]  # there is no conversation 0
    nodes = defaultdict(set)
    for c, p in paths.items():
        state = mark()
        nodes[0, state.hexdigest()].add(c)
        for d, text in enumerate(p):
            state.update(f"{len(text)}:{text}".encode())
            nodes[d + 1, state.hexdigest()].add(c)
    assert sorted((d, min(m), len(m)) for (d, _), m in nodes.items()) == sorted((r[1], r[0], r[3]) for r in made)
    assert at[1, 0][5] == sum(r[4] == 0 for r in made) and at[1, 0][6] == sum((r[3] - 1) * len(paths[r[0]][r[1] - 1]) for r in made if r[1])


def test_an_empty_table_has_no_node(spark):
    assert trie_of(spark, [], 10) == [] and trie_of(spark, [(None, 1, "user", "a")], 10) == []


def test_splitting_needs_few_rounds_on_a_chain():
    n = 3000
    out = prefix_trie.split([-1, *range(n - 1)], [1] * n, [[1] * n, list(range(n))])
    assert out[0] == list(range(n, 0, -1)) and out[1][0] == n * (n - 1) // 2


def test_digests_join_pieces_of_one_node(spark):
    ids = random.Random(2).sample(range(10**6), 5000)
    ends = spark.createDataFrame([(1, 2, i) for i in ids] + [(5, 2, 5)], "rep bigint, depth bigint, conv_id bigint")
    made = {r.rep: r.ids_sha256 for r in prefix_trie.digests(ends, chunk=300).collect()}
    assert made == {1: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), 5: hashlib.sha256(b"5").hexdigest()}
