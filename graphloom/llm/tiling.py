"""Benchmark decontamination by greedy string tiling.

A document is compared with a benchmark item only if both hold one run of ``min_match`` equal
tokens (the seeds). For such a pair, greedy string tiling marks the longest non-overlapping
matches first, found by running Karp-Rabin hashes, so passages in another order count in full.
An item leaks if the tiles cover at least ``threshold`` of its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm._common import doc_text, with_results

MIN_MATCH = 5
THRESHOLD = 0.6
#: Characters of benchmark text that one broadcast holds; a larger benchmark is taken in blocks, one pass each.
BLOCK_CHARS = 16_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))

LEAK = T.ArrayType(
    T.StructType(
        [
            T.StructField("item", T.LongType()),
            T.StructField("n_tiles", T.LongType()),
            T.StructField("matched", T.LongType()),
            T.StructField("item_tokens", T.LongType()),
            T.StructField("coverage", T.DoubleType()),
        ]
    )
)


def tokens(text: str) -> list[bytes]:
    """Tokens: runs of anything but ASCII punctuation, controls and space, in UTF-8, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().translate(PLAIN).split()


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``length`` ids."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    values = ids.astype(np.uint64) + np.uint64(1)
    for j in range(length):
        out *= BASE
        out += values[j : j + n]
    return out


def unmarked_windows(free: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows of ``length`` whose places are all free."""
    total = np.concatenate(([0], np.cumsum(free)))
    return np.flatnonzero(total[length:] - total[:-length] == length) if len(free) >= length else np.empty(0, np.int64)


def greedy_tiles(item: np.ndarray, text: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (item start, text start, length), longest first; ties go to the smaller item start, then text start."""
    item_free, text_free = np.ones(len(item), bool), np.isin(text, item)
    tiles: list[tuple[int, int, int]] = []
    length = min(len(item), len(text))
    while length >= min_match:
        starts, places = unmarked_windows(item_free, length), unmarked_windows(text_free, length)
        table: dict[int, list[int]] = {}
        if len(starts) and len(places):
            hashes = rolling(item, length)[starts]
            for start, value in zip(starts.tolist(), hashes.tolist()):
                table.setdefault(value, []).append(start)
            found = rolling(text, length)[places]
            hit = np.isin(found, hashes)
            places, found = places[hit], found[hit]
        if not table or not len(places):
            # no match of this length: halve, as far as shorter ones can still be told apart
            length = next_length(item, text, item_free, text_free, length, min_match)
            continue
        matches = sorted((start, place) for place, value in zip(places.tolist(), found.tolist()) for start in table[value])
        for start, place in matches:
            if item_free[start : start + length].all() and text_free[place : place + length].all():
                if np.array_equal(item[start : start + length], text[place : place + length]):
                    item_free[start : start + length] = False
                    text_free[place : place + length] = False
                    tiles.append((start, place, length))
        length = next_length(item, text, item_free, text_free, length, min_match)
    return tiles


def next_length(item: np.ndarray, text: np.ndarray, item_free: np.ndarray, text_free: np.ndarray, below: int, min_match: int) -> int:
    """The longest length under ``below`` at which free windows of both still share a hash; bisection, since a match has all shorter ones."""
    low, high = min_match - 1, below - 1
    while low < high:
        middle = (low + high + 1) // 2
        a, b = unmarked_windows(item_free, middle), unmarked_windows(text_free, middle)
        shared = len(a) and len(b) and np.isin(rolling(text, middle)[b], rolling(item, middle)[a]).any()
        if shared:
            low = middle
        else:
            high = middle - 1
    return low


class Block:
    """Seeds and tokens of some benchmark items. Items shorter than ``min_match`` must be found whole."""

    def __init__(self, items: list[tuple[int | None, str]], min_match: int, threshold: float):
        words: dict[bytes, int] = {}
        self.items = [(i, np.array([words.setdefault(w, len(words) + 1) for w in tokens(text)], np.int64)) for i, text in items]
        self.words, self.threshold, self.min_match = words, threshold, min_match
        seeds: dict[int, dict[int, set[int]]] = {}
        for k, (_, ids) in enumerate(self.items):
            if length := min(len(ids), min_match):
                for value in rolling(ids, length).tolist():
                    seeds.setdefault(length, {}).setdefault(value, set()).add(k)
        self.seeds = {length: (np.array(sorted(table), np.uint64), table) for length, table in seeds.items()}

    def leaks(self, texts: list[str]) -> list[list[dict]]:
        lookup, absent = self.words.get, repeat(0)
        documents = [np.fromiter(map(lookup, tokens(text), absent), np.int64) for text in texts]
        gap = np.zeros(1, np.int64)
        ids = np.concatenate([x for d in documents for x in (d, gap)]) if documents else gap
        ends = np.cumsum([len(d) + 1 for d in documents])
        candidates: dict[int, set[int]] = {}
        for length, (values, table) in self.seeds.items():
            at = unmarked_windows(ids > 0, length)
            if not len(at):
                continue
            hashes = np.zeros(len(at), np.uint64)
            for j in range(length):
                hashes *= BASE
                hashes += ids[at + j].astype(np.uint64) + np.uint64(1)
            place = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
            hit = values[place] == hashes
            for d, value in set(zip(np.searchsorted(ends, at[hit], "right").tolist(), hashes[hit].tolist())):
                candidates.setdefault(d, set()).update(table[value])
        return [[leak for k in sorted(candidates.get(d, ())) if (leak := self.compare(k, ids_of))] for d, ids_of in enumerate(documents)]

    def compare(self, k: int, text: np.ndarray) -> dict | None:
        name, item = self.items[k]
        tiles = greedy_tiles(item, text, min(self.min_match, len(item)))
        matched = sum(t[2] for t in tiles)
        if not tiles or matched < self.threshold * len(item):
            return None
        return {"item": name, "n_tiles": len(tiles), "matched": matched, "item_tokens": len(item), "coverage": matched / len(item)}


def blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark in blocks of at most ``limit`` characters (an item longer than that is a block of its own)."""
    block, size = [], 0
    for row in benchmark.select(F.col(f"`{item}`").cast("long"), doc_text(text)).toLocalIterator():
        if block and size + len(row[1]) > limit:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield block


def mark_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    min_match: int = MIN_MATCH,
    threshold: float = THRESHOLD,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Each row of ``docs`` (struct ``row``) with its array ``leaks`` of items whose coverage reaches ``threshold``.

    Null texts count as empty; an empty document or an empty item leaks nothing. An item with fewer
    than ``min_match`` tokens leaks if it occurs whole. Repeated documents and repeated items give
    repeated results. Item ids must be whole numbers of 64 bits. Without items, ``leaks`` is empty everywhere. No shuffle: the benchmark is the
    query set and travels in blocks of bounded size.
    """
    spark = docs.sparkSession
    columns = docs.columns
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.array().cast(LEAK).alias("leaks"))
    arrow = pa.list_(pa.struct([("item", pa.int64()), ("n_tiles", pa.int64()), ("matched", pa.int64()), ("item_tokens", pa.int64()), ("coverage", pa.float64())]))
    for items in blocks(benchmark, item, item_text, block_chars):
        held = spark.sparkContext.broadcast(items)
        ready: dict[str, Block] = {}

        def run(texts: list[str], held=held, ready=ready) -> list[pa.Array]:
            block = ready.get("block") or ready.setdefault("block", Block(held.value, min_match, threshold))
            found: list[list[dict]] = []
            at = 0
            while at < len(texts):  # slices of bounded text
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= 8_000_000):
                    size += len(texts[end])
                    end += 1
                found += block.leaks(texts[at:end])
                at = end
            return [pa.array(found, arrow)]

        source = out.select("row", "leaks", F.col(f"row.`{text}`").alias("text"))
        marked = with_results(source, "text", run, [T.StructField("found", LEAK)])
        out = marked.select(F.col("row.row").alias("row"), F.concat("row.leaks", "found").alias("leaks"))
    return out


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each leaking (document, item)."""
    marked = mark_leaks(docs.select("doc_id", "text"), benchmark)
    return marked.select(F.col("row.doc_id").alias("doc_id"), F.explode("leaks").alias("leak")).select(
        "doc_id",
        F.col("leak.item").alias("item_id"),
        F.col("leak.n_tiles").alias("n_tiles"),
        F.col("leak.matched").alias("matched_tokens"),
        F.col("leak.item_tokens").alias("item_tokens"),
        F.col("leak.coverage").alias("coverage"),
    )
