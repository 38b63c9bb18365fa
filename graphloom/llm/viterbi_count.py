"""Token counts of a unigram vocabulary without token lists.

An Aho-Corasick automaton enumerates the vocabulary pieces in a text; dynamic programming carries,
for each place, only the best score and the number of pieces behind it. Ties fall as in the
tokenizers library's Unigram model: a path replaces another only if its score is greater, and
shorter starts come first, so of equal paths to a place the one with the longest last piece stays.
A character without a piece of its own may pass as unknown, at the least score of the vocabulary
less ten, and counts as the pieces of its bytes.

No piece has a space mark after another character, and none holds a line break, so every path
breaks there: a text is the sum of its words, and a word is worked out once per worker.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm._common import with_results

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct words that a worker remembers, and the longest of them in characters: at most about 60 MB. A longer one is
#: forgotten with its slice, and beyond the number the memory starts anew (results don't depend on either).
CACHE_WORDS = 300_000
CACHE_CHARS = 48
#: Characters of text split at a time.
SLICE_CHARS = 5_000_000
FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())]


class CountingViterbi:
    """``pieces``: (piece, score) in order of id, with all 256 byte pieces. Sums are exact where scores are whole numbers."""

    def __init__(self, pieces: list[tuple[str, float]]):
        names = {p for p, _ in pieces}
        if not all(f"<0x{b:02X}>" in names for b in range(256)):
            raise ValueError("the vocabulary needs its 256 byte pieces")
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in names):
            raise ValueError("a piece goes past a space mark or a line break")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.words: dict[str, complex] = {}

    def word(self, text: str) -> complex:
        """Best score (real part) and its number of pieces (imaginary part)."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        done = 0  # places up to here are settled
        reached = single = False
        unknown = self.unknown
        for last, (length, value) in self.automaton.iter(text):
            end = last + 1
            while done + 1 < end:  # the place before is complete
                if not single:
                    candidate = score[done] + unknown
                    if not reached or candidate > score[done + 1]:
                        score[done + 1], count[done + 1] = candidate, count[done] + len(text[done].encode("utf-8", "surrogatepass"))
                done += 1
                reached = single = False
            candidate = score[end - length] + value
            if not reached or candidate > score[end]:
                score[end], count[end] = candidate, count[end - length] + 1
                reached = True
            single = single or length == 1
        while done < n:
            if not single:
                candidate = score[done] + unknown
                if not reached or candidate > score[done + 1]:
                    score[done + 1], count[done + 1] = candidate, count[done] + len(text[done].encode("utf-8", "surrogatepass"))
            done += 1
            reached = single = False
        return complex(score[n], count[n])

    def texts(self, texts: list[str]) -> list[complex]:
        out: list[complex] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE_CHARS):
                size += len(texts[end])
                end += 1
            rows = [split(t) for t in texts[at:end]]
            if len(self.words) > CACHE_WORDS:
                self.words = {}
            words = self.words
            new = set().union(*rows).difference(words)
            for w in new:
                words[w] = self.word(w)
            out += [sum(map(words.__getitem__, row), 0j) for row in rows]
            for w in new:
                if len(w) > CACHE_CHARS:
                    del words[w]
            at = end
        return out


SPLIT = re.compile(rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def split(text: str) -> list[str]:
    """Words with the space marks before them; one mark is put before a text that starts without."""
    if not text:
        return []
    marked = text.replace(" ", MARK)
    return SPLIT.findall(marked if marked[0] == MARK else MARK + marked)


@lru_cache(maxsize=2)
def model(path: str) -> CountingViterbi:
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return CountingViterbi([(pieces.id_to_piece(i), pieces.get_score(i)) for i in range(pieces.get_piece_size())])


def count_rows(docs: DataFrame, model_path: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Each row of ``docs`` (struct ``row``) with ``n_tokens`` and the best ``score`` of its text.

    A null or empty text has no tokens and score 0. Repeated rows stay repeated; an empty table gives
    an empty result. Memory is bounded by one slice of texts (or the longest text), the longest word and
    ``CACHE_WORDS`` words of at most ``CACHE_CHARS`` characters.
    """

    def run(texts: list[str]) -> list[pa.Array]:
        found = model(model_path).texts(texts)
        return [pa.array([int(c.imag) for c in found], pa.int64()), pa.array([c.real for c in found], pa.float64())]

    return with_results(docs, text, run, FIELDS, carry, lambda: model(model_path).words.clear())


def query(docs: DataFrame, model_path: str) -> DataFrame:
    return count_rows(docs, model_path, carry=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "score")
