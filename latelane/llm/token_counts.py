"""Token counts of a unigram vocabulary without making the tokens.

An Aho-Corasick automaton finds every vocabulary piece that ends at a character, longest
first. The best segmentation up to there has a score and a piece count, and only those of
the last few characters, as many as the longest piece has, are kept. Ties follow the
tokenizers library: of equal scores the piece that starts first wins. A character that is
no piece itself is unknown, ten below the lowest score; a run of unknown characters is one
token, or one per UTF-8 byte where the vocabulary has byte pieces.

Spaces become the word mark, a text gets one in front unless it begins with one, and each
mark begins a word, as with a Metaspace pre-tokenizer. Counts of words met before are
remembered up to a bound. Null and empty texts have no tokens; repeated rows are counted
one by one; only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame

from latelane.llm.common import file_bytes, map_rows

MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value of unigram tokenizers
CACHE_WORDS = 400_000
LONGEST_CACHED = 64


@dataclass(frozen=True)
class Unigram:
    """Pieces with scores, and whether unknown characters fall back to bytes."""

    pieces: tuple[tuple[str, float], ...]
    byte_fallback: bool


def vocabulary(model: bytes) -> Unigram:
    """The pieces of a sentencepiece model file with the scores they have there."""
    of = sentencepiece.SentencePieceProcessor(model_proto=model)
    ids = range(of.get_piece_size())
    plain = [i for i in ids if not (of.is_unknown(i) or of.is_control(i) or of.is_byte(i) or of.is_unused(i))]
    pieces = tuple((of.id_to_piece(i), of.get_score(i)) for i in plain)
    return Unigram(pieces, sum(of.is_byte(i) for i in ids) == 256)


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, unigram: Unigram):
        self.automaton = ahocorasick.Automaton()
        for piece, score in unigram.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in unigram.pieces), default=0.0) - UNKNOWN_PENALTY
        self.kept = max((len(p) for p, _ in unigram.pieces), default=1) + 1
        self.byte_fallback = unigram.byte_fallback
        self.known: dict[str, int] = {}

    def of_word(self, word: str) -> int:
        """Pieces of the best segmentation of a word with its mark."""
        size = self.kept
        scores, counts, unknown = [0.0] * size, [0] * size, [False] * size
        found = self.automaton.iter(word)
        end, piece = next(found, (-1, None))
        for at, character in enumerate(word):
            best, count, single = None, 0, False
            while piece is not None and end == at:
                length, score = piece
                before = (at + 1 - length) % size
                candidate = scores[before] + score
                if best is None or candidate > best:
                    best, count = candidate, counts[before] + 1
                single = single or length == 1
                end, piece = next(found, (-1, None))
            is_unknown, before, now = False, at % size, (at + 1) % size
            if not single:
                candidate = scores[before] + self.unknown
                if best is None or candidate > best:
                    best, is_unknown = candidate, True
                    if self.byte_fallback:
                        count = counts[before] + len(character.encode())
                    else:
                        count = counts[before] + (not unknown[before])
            scores[now], counts[now], unknown[now] = best, count, is_unknown
        return counts[len(word) % size]

    def of_text(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        if not words[0]:
            del words[0]
        known, total = self.known, 0
        for word in words:
            n = known.get(word)
            if n is None:
                n = self.of_word(MARK + word)
                if len(word) <= LONGEST_CACHED:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[word] = n
            total += n
        return total


_counters: dict[Unigram, Counter] = {}


def counter(unigram: Unigram) -> Counter:
    """The process's counter for a vocabulary, kept between tasks."""
    if unigram not in _counters:
        _counters.clear()
        _counters[unigram] = Counter(unigram)
    return _counters[unigram]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_chars and n_tokens of every row of ``docs`` (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(vocabulary(file_bytes(path)))  # the file's pieces

    def make():
        of_text = counter(model.value).of_text
        return lambda doc_id, text: [(doc_id, len(text or ""), of_text(text or ""))]

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars bigint, n_tokens bigint"
    return map_rows(docs.select("doc_id", "text"), schema, make)
