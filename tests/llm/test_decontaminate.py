"""What decontamination tells of a document, against brute force, and its bounds."""

import random

import pytest

from pulsegrain.llm import decontaminate
from tests.llm.test_operators import brute_windows, frame


def brute_matches(text, items, width):
    """Maximal verbatim runs of at least a window, by item: how many, and the first longest with its places."""
    doc, out = decontaminate.split_words((text or "").encode()), {}
    for name, body in items:
        own = decontaminate.split_words((body or "").encode())
        n, seen, places = min(width, len(own)), set(), set()
        for t in range(len(own) - n + 1 if n else 0):
            window = tuple(own[t:t + n])
            if window not in seen:  # a window that an item repeats is located at its first place
                seen.add(window)
                places |= {(p, t) for p in range(len(doc) - n + 1) if tuple(doc[p:p + n]) == window}
        runs = []
        for p, t in places:
            if (p - 1, t - 1) not in places:
                k = 0
                while (p + k + 1, t + k + 1) in places:
                    k += 1
                runs.append((-(k + n), p, t))
        if runs:
            size, p, t = min(runs)
            out[name] = (len(runs), p, t, -size)
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
@pytest.mark.parametrize("at_once", [1, 1 << 20])
def test_longest_matches_and_runs(spark, monkeypatch, block_bytes, at_once):
    monkeypatch.setattr(decontaminate, "AT_ONCE", at_once)
    draw = random.Random(17)
    make = lambda n: " ".join(draw.choice(["a", "b", "c"]) for _ in range(n))
    items = [(str(i), make(draw.randint(0, 12))) for i in range(12)] + [("none", None)]
    texts = [make(draw.randint(0, 50)) for _ in range(40)] + [None, "", "a " * 300]
    out = decontaminate.find_matches(frame(spark, texts), spark.createDataFrame(items, "item_id string, text string"), "hits", width=4, block_bytes=block_bytes)
    for r in out.collect():
        text = texts[r.doc_id]
        n_words, n_hit, named = brute_windows(text, items, 4)
        found = r.hits
        assert (found.n_words, found.n_hit, list(found["items"])) == (n_words, n_hit, named)
        assert {m["item"]: (m.n_matches, m.doc_word, m.item_word, m.n_words) for m in found.matches} == brute_matches(text, items, 4)
        assert sum(h.n_words for h in found["hits"]) == n_hit
        ends = [(h.doc_word, h.doc_word + h.n_words) for h in found["hits"]]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_equal_words_in_many_items_stay_small():
    block = decontaminate.test_block([(str(i), "a " * 50) for i in range(300)])
    found = decontaminate.search_shard([b"a " * 20000, b"b", None], block)
    assert [f["n_hit"] for f in found] == [20000, 0, 0] and len(found[0]["matches"]) == 300
    assert found[0]["hits"] == [{"doc_word": 0, "n_words": 20000}]


def test_windows_are_told_apart_by_their_length():
    """A short item is no prefix of a longer window, and ids beyond it fill no window."""
    block = decontaminate.test_block([("s", "a b"), ("l", "a b c d e f g h i j k")])
    found = decontaminate.search_shard([b"x a b x", b"a b c d e f g h i j", b"b c d e f g h i j k"], block)
    assert [f["items"] for f in found] == [["s"], ["l", "s"], ["l"]]
