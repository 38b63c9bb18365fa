"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pretokens of an Arrow batch are laid out as one symbol array. An index maps each
mergeable pair to all its positions. Active ranks are applied in ascending order; a merge visits
only the listed positions and files the new neighbour pairs under their own ranks. Every step is a
numpy operation over all positions of the pair, and a pretoken is encoded once per worker.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm._common import with_results

# Fixed value: the public pretokenizer pattern of byte-level BPE, with white space spelt as the Unicode property.
PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: The same split for texts of plain characters only, where the standard library's faster engine gives equal pieces.
PLAIN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
NOT_PLAIN = re.compile("[^\n\x20-\x7e\u00c0-\u024f]")
#: Characters of text split at a time, to bound the memory of the pieces.
SLICE_CHARS = 5_000_000
#: Distinct pretokens that a task remembers, and the longest of them in characters: at most about 60 MB. A longer one is
#: forgotten with its slice, and beyond the number the memory starts anew (results don't depend on either).
CACHE_WORDS = 200_000
CACHE_CHARS = 48


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character of each byte: itself where printable, else the next code point from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairIndexBPE:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for char, b in alphabet.items():
            self.byte_ids[b] = vocab[char]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.product = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = self.left * size + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.size = keys[self.order], size
        self.words: dict[str, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.order[at], -1)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as packed little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        n = int(lengths.sum())
        if not n:
            return [b""] * len(words)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        symbol = np.empty(n + 1, np.int64)
        symbol[:n] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        symbol[n] = -1  # the border of every word
        following, previous = np.arange(1, n + 2), np.arange(-1, n)
        following[ends[lengths > 0] - 1] = n
        previous[starts[lengths > 0]] = n

        positions: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def file(at: np.ndarray) -> None:
            rank = self.ranks(symbol[at], symbol[following[at]])
            found = rank >= 0
            at, rank = at[found], rank[found]
            if not len(at):
                return
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for group, first in zip(np.split(at, cuts), rank[np.concatenate(([0], cuts))].tolist()):
                if first in positions:
                    positions[first].append(group)
                else:
                    positions[first] = [group]
                    heapq.heappush(active, first)

        file(np.arange(n))
        while active:
            rank = heapq.heappop(active)
            listed = positions.pop(rank)
            at = listed[0] if len(listed) == 1 else np.concatenate(listed)  # a position is listed once per pair
            a, b = self.left[rank], self.right[rank]
            at = at[(symbol[at] == a) & (symbol[following[at]] == b)]
            if a == b and len(at) > 1:  # in a run of equal symbols, every second position merges
                at = np.sort(at)
                chained = following[at[:-1]] == at[1:]
                index = np.arange(len(at))
                run_start = np.maximum.accumulate(np.where(np.concatenate(([True], ~chained)), index, 0))
                at = at[(index - run_start) % 2 == 0]
            if not len(at):
                continue
            gone = following[at]
            after = following[gone]
            symbol[at] = self.product[rank]
            symbol[gone] = -2
            following[at] = after
            previous[after] = at
            before = previous[at]
            before = before[before < n]
            file(np.concatenate((before[symbol[before] != self.product[rank]], at)))
        kept = symbol[:n] >= 0
        counts = np.concatenate(([0], np.cumsum(kept)))
        packed = symbol[:n][kept].astype("<u4").tobytes()
        first, last = (counts[starts] * 4).tolist(), (counts[ends] * 4).tolist()
        return [packed[i:j] for i, j in zip(first, last)]

    def split(self, text: str) -> list[str]:
        return (PRETOKEN if NOT_PLAIN.search(text) else PLAIN).findall(text)

    def pieces(self, text: str) -> list[str]:
        if self.split_added is None or not self.split_added.search(text):
            return self.split(text)
        out, at = [], 0
        for match in self.split_added.finditer(text):
            out += self.split(text[at : match.start()])
            out.append(match[0])
            at = match.end()
        return out + self.split(text[at:])

    def forget(self) -> None:
        self.words = {}

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE_CHARS):
                size += len(texts[end])
                end += 1
            rows = [self.pieces(text) for text in texts[at:end]]
            if len(self.words) > CACHE_WORDS:
                self.words = {}
            words = self.words
            new = list(set().union(*rows).difference(words, self.added))
            words.update(zip(new, self.encode_words([w.encode() for w in new])))
            words.update((token, np.array([i], "<u4").tobytes()) for token, i in self.added.items())
            out += [b"".join(map(words.__getitem__, row)) for row in rows]
            for w in new:
                if len(w) > CACHE_CHARS:
                    del words[w]
            at = end
        return out

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model(path: str) -> PairIndexBPE:
    return PairIndexBPE(path)


FIELDS = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]


def encode_rows(docs: DataFrame, tokenizer_path: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Each row of ``docs`` (struct ``row``), its ids (packed little-endian unsigned 32-bit) and the decoded text.

    A null text counts as empty and has no ids. Repeated rows stay repeated; an empty table gives an
    empty result. Special tokens that stand in a text get their own ids, as in the tokenizers library.
    Bounded memory: one slice of texts (or the longest text) and ``CACHE_WORDS`` remembered pretokens of at most
    ``CACHE_CHARS`` characters.
    """

    def run(texts: list[str]) -> list[pa.Array]:
        bpe = model(tokenizer_path)
        packed = bpe.encode_batch(texts)
        return [pa.array(packed, pa.binary()), pa.array([bpe.decode(p) for p in packed], pa.string())]

    return with_results(docs, text, run, FIELDS, carry, lambda: model(tokenizer_path).forget())


def query(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return encode_rows(docs, tokenizer_path, carry=["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"),
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
