"""Token counts by count-only Viterbi over a unigram vocabulary.

A text is cut before each space, which becomes the piece mark. In each such word an Aho-Corasick automaton enumerates
the vocabulary's pieces by their last character, longest first, and dynamic programming over the characters carries
the best score and the number of pieces of the best path; no path is kept. Ties go to the path found first, as
in the public unigram tokenizer: a later start must score higher to win, and the unknown character (lowest score
less 10, allowed only where its character is no piece) comes last. An unknown character counts as its UTF-8 bytes
(byte fallback). Counts of words are remembered within a task, at most ``REMEMBERED`` of them.

The public files hold no unigram model: the vocabulary is the pieces and scores of the sentencepiece file.

Defined cases: NULL and empty texts have 0 tokens; whole texts count, whatever their length; rows are not moved.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
REMEMBERED = 1 << 20


def load_pieces(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file, in order of its ids; unknown, control and byte entries apart."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())
            if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]


class Counter:
    """Counts tokens; holds the automaton, which every task builds once from the pieces."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - 10.0
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Number of pieces of the best path through one word."""
        ends: list[list[tuple[int, float]]] = [[] for _ in word]
        for end, piece in self.automaton.iter(word):
            ends[end].append(piece)
        scores, counts = [0.0], [0]
        for end, pieces in enumerate(ends):
            best, count = None, 0
            for length, score in sorted(pieces, reverse=True):
                score += scores[end + 1 - length]
                if best is None or score > best:
                    best, count = score, counts[end + 1 - length] + 1
            if word[end] not in self.single:
                score = scores[end] + self.unknown
                if best is None or score > best:
                    best, count = score, counts[end] + len(word[end].encode())
            scores.append(best)
            counts.append(count)
        return counts[-1]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        if not words[0]:  # the text starts with the mark itself
            words = words[1:]
        total = 0
        for word in words:
            count = self.known.get(word)
            if count is None:
                count = self.word(MARK + word)
                if len(self.known) < REMEMBERED and len(word) < 100:
                    self.known[word] = count
            total += count
        return total


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], n_tokens: str = "n_tokens", text: str = "text") -> DataFrame:
    """``docs`` with a column ``n_tokens``."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # a vocabulary, whatever the documents
    made = []

    def count(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Counter(shared.value))
        return pa.array([made[0].text(t.as_py()) for t in texts], pa.int64())

    return docs.withColumn(n_tokens, F.arrow_udf(count, "bigint")(F.col(f"`{text}`")))
