"""Benchmark decontamination with suffix arrays over the training text.

Each task turns the documents of a batch into one shard: their words as numbers of the benchmark's vocabulary,
0 for any other word and between documents. The shard's suffix array sorts all suffixes that lie inside the
vocabulary for at least the shortest window, by their first ``width`` words. Every test suffix is binary-searched in
it. A suffix found with ``width`` words, or an item shorter than that found whole, is an occurrence; occurrences on
one diagonal (same item, next word in both) join to the longest verbatim match there. Told are, for each item: how
many such matches the document holds, and the first of the longest ones with its places; and the runs of hit words.

Nothing is shuffled. The benchmark goes to all tasks, in blocks of at most ``block_bytes`` of text; documents are read
once per block, and what a block found is written to the shared folder before the next one starts. A block's windows are
packed numbers, about 50 bytes a word; occurrences meet the items that share them in slices of ``AT_ONCE`` at most, or as
many as a shard has words.

Words are runs of ASCII letters and digits and of any characters beyond ASCII; A-Z count as a-z. Defined cases: NULL
has no words, and neither hits nor is hit. Items with one id are one item. A window that an item repeats
is located at its first place there. Repeated documents are judged alike, rows are never dropped by ``find_matches``.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsegrain.llm.common import fresh, shared, staged

WIDTH = 10
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 4 << 20
AT_ONCE = 1 << 20
WORD_BYTES = set(b"abcdefghijklmnopqrstuvwxyz0123456789") | set(range(128, 256))
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b in WORD_BYTES else 32 for b in range(256))
FOUND = ("n_words bigint, n_hit bigint, items array<string>, hits array<struct<doc_word:bigint, n_words:bigint>>, "
         "matches array<struct<item:string, n_matches:bigint, doc_word:bigint, item_word:bigint, n_words:bigint>>")


def shards(texts: pa.Array) -> Iterator[list[bytes | None]]:
    """Runs of whole texts of about ``SHARD_BYTES``; a longer text is a shard of its own."""
    shard, size = [], 0
    for text in texts:
        shard.append(text.as_py())
        size += len(shard[-1] or b"")
        if size >= SHARD_BYTES:
            yield shard
            shard, size = [], 0
    if shard:
        yield shard


def split_words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLDED).split() if text else []


@dataclass
class TestBlock:
    """Distinct windows of some benchmark items, as rows of packed word numbers that sort like the words' numbers."""
    vocabulary: dict[bytes, int]
    names: list[str]
    width: int
    bits: int
    low: list[np.ndarray]  # packed windows, short ones filled with 0
    short: np.ndarray  # the short ones, and
    fill: list[np.ndarray]  # what makes them the largest row that begins so
    length: np.ndarray
    starts: np.ndarray  # places of window i: starts[i] to starts[i + 1]
    item: np.ndarray  # ascending within a window
    place: np.ndarray

    def high(self) -> list[np.ndarray]:
        out = [k.copy() for k in self.low]
        for key, fill in zip(out, self.fill):
            key[self.short] |= fill
        return out


def pack(columns: Callable[[int], np.ndarray], width: int, bits: int) -> list[np.ndarray]:
    """``width`` columns of numbers as a few columns of 64 bits; one column is made at a time."""
    per = 64 // bits
    out = []
    for i in range(0, width, per):
        key = columns(i).astype(np.uint64)
        for j in range(i + 1, min(i + per, width)):
            key = (key << np.uint64(bits)) | columns(j).astype(np.uint64)
        out.append(key << np.uint64(bits * (per - min(per, width - i))))
    return out


def test_block(items: Iterable[tuple[str, str | None]], width: int = WIDTH) -> TestBlock:
    vocabulary: dict[bytes, int] = {}
    names: dict[str, int] = {}
    words, sizes, owner = array("l"), array("l"), array("l")
    for name, text in items:
        before = len(words)
        words.extend(vocabulary.setdefault(w, len(vocabulary) + 1) for w in split_words((text or "").encode()))
        if len(words) > before:
            sizes.append(len(words) - before)
            owner.append(names.setdefault(name, len(names)))
    ids = np.concatenate([np.array(words, np.int64), np.zeros(width, np.int64)])
    size, bits = np.array(sizes, np.int64), (len(vocabulary) + 1).bit_length()
    count = np.maximum(size - width + 1, 1)
    begin = np.cumsum(size) - size
    at = ranges(begin, count)
    length = np.repeat(np.minimum(size, width), count).astype(np.int16)
    low = pack(lambda j: np.where(j < length, ids[at + j], 0), width, bits)
    item, place = np.repeat(np.array(owner, np.int32), count), (at - np.repeat(begin, count)).astype(np.int32)
    # Windows in order, the places of each by item, of which the first in each item stays.
    order = np.lexsort((place, item, *low[::-1]))
    low, item, place, length = [k[order] for k in low], item[order], place[order], length[order]
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in low], axis=0)
    first = new.copy()
    first[1:] |= item[1:] != item[:-1]
    starts = np.append(np.flatnonzero(new[first]), first.sum())
    low, length = [k[new] for k in low], length[new]
    short = np.flatnonzero(length < width)
    fill = pack(lambda j: np.where(j < length[short], 0, (1 << bits) - 1), width, bits)
    return TestBlock(vocabulary, list(names), width, bits, low, short, fill, length, starts, item[first], place[first])


def bound(keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
    """Binary search of all wanted rows at once among the sorted rows ``keys``: first row not below (not above)."""
    low = np.zeros(len(wanted[0]), np.int64)
    high = np.full(len(wanted[0]), len(keys[0]), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        below = np.full(open_.size, after)
        for key, want in zip(reversed(keys), reversed(wanted)):
            a, b = key[mid], want[open_]
            below = (a < b) | ((a == b) & below)
        low[open_[below]] = mid[below] + 1
        high[open_[~below]] = mid[~below]
    return low


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for count[i] numbers each, one after the other."""
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


def search_shard(texts: list[bytes | None], block: TestBlock) -> list[dict]:
    """What ``FOUND`` holds, for each text of one shard."""
    get = block.vocabulary.get
    docs = [split_words(t) for t in texts]
    sizes = np.array([len(d) for d in docs], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])  # one 0 after each document
    ids = np.zeros(first[-1] + block.width, np.int64)
    for start, words in zip(first, docs):
        ids[start:start + len(words)] = [get(w, 0) for w in words]
    out = [{"n_words": int(n), "n_hit": 0, "items": [], "hits": [], "matches": []} for n in sizes]
    if not len(block.length) or not first[-1]:
        return out
    ends = np.flatnonzero(ids == 0)
    at = np.flatnonzero(ids)
    room = ends[np.searchsorted(ends, at)] - at
    at, room = (x[room >= block.length.min()] for x in (at, room))
    if not at.size:
        return out
    keys = pack(lambda j: np.where(j < room, ids[at + j], 0), block.width, block.bits)
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    low, high = bound(keys, block.low, False), bound(keys, block.high(), True)
    found = np.flatnonzero(low < high)
    window = np.repeat(found, (high - low)[found])
    where = at[order[ranges(low[found], (high - low)[found])]]
    if not where.size:
        return out

    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, where, 1)
    np.add.at(edge, where + block.length[window], -1)
    covered = np.concatenate([[0], np.cumsum(edge) > 0, [0]]).astype(np.int8)
    run, end = (np.flatnonzero(np.diff(covered) == step) for step in (1, -1))
    for d, r, e in zip(np.searchsorted(first, run, "right") - 1, run, end):
        out[d]["hits"].append({"doc_word": int(r - first[d]), "n_words": int(e - r)})
        out[d]["n_hit"] += int(e - r)

    # Places in the order (window, item), so that those of some items are found within each window.
    n_items = len(block.names)
    owner = np.repeat(np.arange(len(block.length)), np.diff(block.starts)) * n_items + block.item
    step = max(1, AT_ONCE // len(where))
    for some in range(0, n_items, step):
        begin, until = (np.searchsorted(owner, window * n_items + min(i, n_items)) for i in (some, some + step))
        for d, match in longest(where, window, begin, until - begin, first, block):
            out[d]["matches"].append(match)
    for row in out:
        row["items"] = sorted(m["item"] for m in row["matches"])
    return out


def longest(where: np.ndarray, window: np.ndarray, begin: np.ndarray, count: np.ndarray, first: np.ndarray,
            block: TestBlock) -> Iterator[tuple[int, dict]]:
    """For each document and item the first of its longest matches, from occurrences and ``count`` places of each."""
    place = ranges(begin, count)
    if not place.size:
        return
    where, span = np.repeat(where, count), np.repeat(block.length[window].astype(np.int64), count)
    item, t = block.item[place].astype(np.int64), block.place[place].astype(np.int64)
    doc = np.searchsorted(first, where, "right") - 1
    order = np.lexsort((where, where - t, item, doc))
    doc, item, where, t, span = (x[order] for x in (doc, item, where, t, span))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (where[1:] != where[:-1] + 1) | (t[1:] != t[:-1] + 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(doc)) - 1
    size = where[last] - where[head] + span[last]
    doc, item, where, t = (x[head] for x in (doc, item, where, t))
    order = np.lexsort((t, where, -size, item, doc))
    doc, item, where, t, size = (x[order] for x in (doc, item, where, t, size))
    best = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]))
    for i, n in zip(best, np.diff(np.append(best, len(doc)))):
        yield int(doc[i]), {"item": block.names[item[i]], "n_matches": int(n), "doc_word": int(where[i] - first[doc[i]]),
                            "item_word": int(t[i]), "n_words": int(size[i])}


def merge(old: dict | None, new: dict) -> dict:
    """Findings of two blocks on one document; their items differ."""
    if not old or not old["matches"]:
        return new
    if not new["matches"]:
        return old
    hits = []
    for start, end in sorted((h["doc_word"], h["doc_word"] + h["n_words"]) for h in old["hits"] + new["hits"]):
        if hits and start <= hits[-1][1]:
            hits[-1][1] = max(hits[-1][1], end)
        else:
            hits.append([start, end])
    matches = old["matches"] + new["matches"]
    return {"n_words": new["n_words"], "n_hit": sum(e - s for s, e in hits), "matches": matches,
            "hits": [{"doc_word": s, "n_words": e - s} for s, e in hits], "items": sorted(m["item"] for m in matches)}


def finder(block):
    """The search as a column function over (text, findings of earlier blocks)."""

    def search(texts: pa.Array, before: pa.Array) -> pa.Array:
        numbers = lambda *names: [(n, pa.int64()) for n in names]
        kind = pa.struct([*numbers("n_words", "n_hit"), ("items", pa.list_(pa.string())),
                          ("hits", pa.list_(pa.struct(numbers("doc_word", "n_words")))),
                          ("matches", pa.list_(pa.struct([("item", pa.string()), *numbers("n_matches", "doc_word", "item_word", "n_words")])))])
        out = []
        for shard in shards(texts.cast(pa.binary())):
            out += search_shard(shard, block())
        return pa.array([merge(o, n) for o, n in zip(before.to_pylist(), out)], kind)

    return F.arrow_udf(search, FOUND)


def find_matches(docs: DataFrame, benchmark: DataFrame, found: str = "found", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct column ``found`` (see ``FOUND``): words, hit words, items, runs of hit words, longest match of each item."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"),
                             F.col(f"`{item_text}`").alias("body"))
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = total // block_bytes + 1
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        block = shared(spark, test_block(((r.item, r.body) for r in part.toLocalIterator()), width))  # at most one block
        before = F.col(f"`{found}`") if k else F.from_json(F.lit(None).cast("string"), FOUND)
        docs = docs.withColumn(found, finder(block)(F.col(f"`{text}`"), before))
        if k < blocks - 1:
            docs = staged(spark, docs, "decontaminate")
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents in which no benchmark window occurs, with their own columns."""
    found = fresh(docs, "found")
    out = find_matches(docs, benchmark, found, text, **options)
    return out.where(F.col(f"`{found}`.n_hit") == 0).drop(found)
