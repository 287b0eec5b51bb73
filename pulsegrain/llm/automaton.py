"""Regular expressions over bytes compiled to one deterministic automaton for many rules.

Syntax: literals, ``\\xHH``, ``\\`` before punctuation, ``[...]`` with ranges and ``^``, ``(...)``, ``|``, ``?``,
``*``, ``+``, ``{n}``, ``{n,}``, ``{n,m}``. A rule's expression becomes a Thompson automaton; subset construction
runs over classes of bytes that no rule tells apart; Moore's refinement merges equal states. The result is
a flat array of transitions, ``next = table[state * classes + class_of[byte]]``, and the set of rules that each
state accepts, as bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.steps: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.steps.append(None)
        return len(self.empty) - 1


class Parser:
    """Recursive descent; every method returns a function that adds the part to an automaton, from start to end."""

    def __init__(self, pattern: str, ignore_case: bool = False):
        self.text, self.at, self.fold = pattern, 0, ignore_case

    def peek(self) -> str:
        return self.text[self.at:self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def either(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())

        def build(nfa: Nfa, start: int) -> int:
            end = nfa.state()
            for part in parts:
                first = nfa.state()
                nfa.empty[start].append(first)
                nfa.empty[part(nfa, first)].append(end)
            return end
        return build

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated())

        def build(nfa: Nfa, start: int) -> int:
            for part in parts:
                start = part(nfa, start)
            return start
        return build

    def repeated(self):
        part = self.atom()
        while self.peek() and self.peek() in "?*+{":
            sign = self.take()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(sign, (0, 0))
            if sign == "{":
                close = self.text.index("}", self.at)
                first, comma, last = self.text[self.at:close].partition(",")
                low, high = int(first), int(last) if last else None if comma else int(first)
                self.at = close + 1
            part = self.times(part, low, high)
        return part

    @staticmethod
    def times(part, low: int, high: int | None):
        def build(nfa: Nfa, start: int) -> int:
            for _ in range(low):
                start = part(nfa, start)
            end = nfa.state()
            nfa.empty[start].append(end)
            if high is None:
                loop = nfa.state()
                nfa.empty[start].append(loop)
                again = part(nfa, loop)
                nfa.empty[again] += [loop, end]
            for _ in range((high or low) - low):
                start = part(nfa, start)
                nfa.empty[start].append(end)
            return end
        return build

    def atom(self):
        sign = self.take()
        if sign == "(":
            inner = self.either()
            if self.take() != ")":
                raise ValueError("unclosed group")
            return inner
        values = self.klass() if sign == "[" else frozenset([self.escaped()]) if sign == "\\" else frozenset([ord(sign)])
        if self.fold:
            values |= {b ^ 32 for b in values if chr(b).isascii() and chr(b).isalpha()}

        def build(nfa: Nfa, start: int) -> int:
            end = nfa.state()
            first = nfa.state()
            nfa.empty[start].append(first)
            nfa.steps[first] = (values, end)
            return end
        return build

    def escaped(self) -> int:
        sign = self.take()
        if sign == "x":
            self.at += 2
            return int(self.text[self.at - 2:self.at], 16)
        if sign.isalnum():
            raise ValueError(f"no escape \\{sign} here")
        return ord(sign)

    def klass(self) -> frozenset[int]:
        negated, values = self.peek() == "^", set()
        self.at += negated
        while (sign := self.take()) != "]":
            first = self.escaped() if sign == "\\" else ord(sign)
            last = first
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                sign = self.take()
                last = self.escaped() if sign == "\\" else ord(sign)
            values |= set(range(first, last + 1))
        return frozenset(set(range(256)) - values if negated else values)


@dataclass
class Dfa:
    classes: int
    class_of: np.ndarray  # 256 byte classes
    table: np.ndarray  # flat, state * classes + class -> state
    accepts: np.ndarray  # bits of the rules that end in a state
    start: int


def compile_rules(patterns: list[tuple[str, bool]], search: bool) -> Dfa:
    """One automaton for all (pattern, ignore case). ``search``: a match may begin at any byte."""
    nfa, ends = Nfa(), {}
    root = nfa.state()
    for bit, (pattern, fold) in enumerate(patterns):
        parser = Parser(pattern, fold)
        first = nfa.state()
        nfa.empty[root].append(first)
        ends[parser.either()(nfa, first)] = 1 << bit
        if parser.at != len(pattern):
            raise ValueError(f"unexpected {pattern[parser.at:]!r}")

    signature = [tuple(i for i, s in enumerate(nfa.steps) if s and b in s[0]) for b in range(256)]
    numbers = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    members = list(numbers)  # of each class: the states that can step on it

    def closed(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in nfa.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(s for s in seen if nfa.steps[s] or s in ends)

    begin = closed([root])
    found, rows, todo = {begin: 0}, [], [begin]
    for state in todo:  # grows while it runs
        row = []
        for can in members:
            after = closed([nfa.steps[i][1] for i in can if i in state])
            after = after | begin if search else after
            if after not in found:
                found[after] = len(found)
                todo.append(after)
            row.append(found[after])
        rows.append(row)
    table = np.array(rows)
    accepts = np.array([sum(ends.get(s, 0) for s in state) for state in found], np.int64)

    _, block = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    # Accepting states get the largest numbers, so that one comparison finds them.
    kept = {b: i for i, b in reversed(list(enumerate(block)))}
    order = sorted(kept, key=lambda b: (accepts[kept[b]] != 0, kept[b]))
    new = {b: i for i, b in enumerate(order)}
    merged = np.array([[new[block[t]] for t in table[kept[b]]] for b in order])
    return Dfa(len(members), np.array([numbers[s] for s in signature], np.int64), merged.ravel().astype(np.int32),
               np.array([accepts[kept[b]] for b in order]), new[block[0]])
