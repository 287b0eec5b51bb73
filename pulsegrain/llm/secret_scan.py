"""Secret scans with one deterministic automaton for all rules.

All rule expressions are compiled together (``automaton.py``). A batch of texts is laid out in lanes that begin behind
bytes on which the automaton always falls back to its start (line ends, for the rules here), and all lanes step
through the transition array side by side: every byte is read once, for all rules. Lanes in which a rule
accepts are then walked again by the same rules' anchored automaton, which gives the spans: for each kind leftmost,
longest, not overlapping.

Defined cases: a NULL text is empty. Spans count code points. A long text is many lanes, and one without a line end a
single long lane. Equal texts give equal spans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsegrain.llm.automaton import Dfa, compile_rules
from pulsegrain.llm.common import shared

SPANS = "array<struct<kind:string, start:bigint, end:bigint>>"
LANE = 1024
SHARD_BYTES = 8 << 20


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    fold: bool = False
    least: int = 0  # least length of the match, or of its value
    value: str | None = None  # expression whose first group is the value; without it the whole match counts

    def holds(self, match: bytes) -> bool:
        return len(re.search(self.value.encode(), match)[1] if self.value else match) >= self.least


# The kinds every scan reports, in this order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", True, 6,
         r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)\Z"""),
    Rule("access", r"AKIA[A-Z0-9]+", False, 20),
    Rule("hex", r"[0-9a-f]{24,}", False, 24),
)
# Token shapes that their issuers publish. Lengths are checked on the match: counters of several rules would multiply
# the states.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=24),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9\-]+", least=15),
    Rule("google", r"AIza[A-Za-z0-9_\-]+", least=34),
    Rule("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)


@dataclass
class Scanner:
    rules: tuple[Rule, ...]
    search: Dfa
    anchored: Dfa
    resets: np.ndarray  # bytes that lead to the start from every state
    rows: list[list[int]]  # of the anchored automaton by state and byte; -1: no match can follow
    bits: list[int]
    ahead: list[int]  # rules that accept in some state after this one, as bits

    @classmethod
    def of(cls, rules: tuple[Rule, ...]) -> Scanner:
        patterns = [(r.pattern, r.fold) for r in rules]
        search, anchored = compile_rules(patterns, True), compile_rules(patterns, False)
        steps = search.table.reshape(-1, search.classes)
        resets = (steps == search.start).all(axis=0)[search.class_of]
        wide = anchored.table.reshape(-1, anchored.classes)[:, anchored.class_of]
        dead = [s for s in range(len(wide)) if not anchored.accepts[s] and (wide[s] == s).all()]
        ahead = np.zeros(len(wide), np.int64)
        while True:
            more = np.bitwise_or.reduce(ahead[wide] | anchored.accepts[wide], axis=1)
            if (more == ahead).all():
                break
            ahead = more
        return cls(rules, search, anchored, resets, np.where(np.isin(wide, dead), -1, wide).tolist(), anchored.accepts.tolist(), ahead.tolist())


def lanes_of(data: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """Where lanes begin: 0, and behind about every ``LANE`` bytes the next byte that resets."""
    spots = np.flatnonzero(resets[data]) + 1
    wanted = np.arange(0, len(data), LANE)
    begins = spots[np.minimum(np.searchsorted(spots, wanted[1:]), len(spots) - 1)] if len(spots) else spots
    return np.unique(np.concatenate([[0], begins[begins < len(data)]])).astype(np.int64)


def flagged(data: np.ndarray, begins: np.ndarray, dfa: Dfa) -> np.ndarray:
    """Which lanes hold a match of any rule: all lanes step one byte at a time."""
    sizes = np.diff(np.append(begins, len(data)))
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[order], sizes[order]
    codes = dfa.class_of.astype(np.uint8)[data]
    accepting = int((dfa.accepts == 0).sum())
    state = np.full(len(begins), dfa.start, np.int32)
    hit = np.zeros(len(begins), bool)
    live = len(begins)
    steps = np.searchsorted(-sizes, -np.arange(sizes[0]) - 0.5) if len(sizes) else []
    for i, live in enumerate(steps):
        state = dfa.table[state[:live] * dfa.classes + codes[begins[:live] + i]]
        hit[:live] |= state >= accepting
    out = np.zeros(len(begins), bool)
    out[order] = hit
    return out


def spans_in(text: bytes, scanner: Scanner) -> list[tuple[str, int, int]]:
    """All matches in a stretch that holds some, as (kind, start, end) in bytes.

    A walk from a byte goes on only while a rule whose last match has ended there can still accept: inside a match,
    however long, the bytes are not walked again for its rule.
    """
    out, n, rows, bits, ahead, start = [], len(text), scanner.rows, scanner.bits, scanner.ahead, scanner.anchored.start
    free = [0] * len(scanner.rules)
    open_, until = (1 << len(free)) - 1, n  # rules that may match from here, and where others may again
    for begin in range(n):
        if begin >= until:
            open_ = sum(1 << k for k, f in enumerate(free) if f <= begin)
            until = min((f for f in free if f > begin), default=n)
        state, i, ends = rows[start][text[begin]], begin + 1, {}
        while state >= 0:
            if bits[state] & open_:
                ends[bits[state]] = i
            if i == n or not ahead[state] & open_:
                break
            state = rows[state][text[i]]
            i += 1
        if ends:
            for k, rule in enumerate(scanner.rules):
                if open_ >> k & 1 and (end := max((e for bit, e in ends.items() if bit >> k & 1), default=0)):
                    free[k] = end
                    if rule.holds(text[begin:end]):
                        out.append((rule.kind, begin, end))
            open_ = sum(1 << k for k, f in enumerate(free) if f <= begin + 1)
            until = min((f for f in free if f > begin + 1), default=n)
    return out


def scan(texts: list[bytes], scanner: Scanner) -> list[list[dict]]:
    """Spans of each text, by start and then rule order."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    begins = lanes_of(data, scanner.resets)
    ends = np.append(begins[1:], len(data))
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    rank = {r.kind: i for i, r in enumerate(scanner.rules)}
    found: dict[int, list[tuple[int, int, str, int]]] = {}
    for lane in np.flatnonzero(flagged(data, begins, scanner.search)):
        base = int(begins[lane])
        for kind, s, e in spans_in(joined[base:ends[lane]], scanner):
            doc = int(np.searchsorted(starts, base + s, "right")) - 1
            shift = base - int(starts[doc])
            found.setdefault(doc, []).append((shift + s, rank[kind], kind, shift + e))
    out: list[list[dict]] = [[] for _ in texts]
    for doc, spans in found.items():
        text, points, at = texts[doc], 0, 0
        for s, _, kind, e in sorted(spans):
            points, at = points + len(text[at:s].decode("utf-8", "replace")), s
            out[doc].append({"kind": kind, "start": points, "end": points + len(text[s:e].decode("utf-8", "replace"))})
    return out


def find_secrets(docs: DataFrame, spans: str = "spans", text: str = "text", more: tuple[Rule, ...] = MORE) -> DataFrame:
    """``docs`` with an array ``spans`` of (kind, start, end) by start, then kind: the base kinds, then ``more``."""
    scanner = shared(docs.sparkSession, Scanner.of((*BASE, *more)))

    def find(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        out, shard, size = [], [], 0
        for value in texts.cast(pa.binary()):
            shard.append(value.as_py() or b"")
            size += len(shard[-1])
            if size >= SHARD_BYTES:
                out += scan(shard, scanner())
                shard, size = [], 0
        return pa.array(out + (scan(shard, scanner()) if shard else []), kind)

    return docs.withColumn(spans, F.arrow_udf(find, SPANS)(F.col(f"`{text}`")))
