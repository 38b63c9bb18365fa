"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood n-gram estimates f_k = c(history, word) / c(history), k = 1 to
``order``, and a uniform f_0. The weights depend on how often the longest history was seen: histories
fall into buckets by the logarithm of their count, and expectation-maximisation learns the weights of
each bucket on counts that were held out: part of the training documents (the deleted fold) is
predicted from the others' counts. Scores then use the counts of all training documents.

Counts are exchanged in bulk. Documents are packed into chunks, written once. A chunk sends the sorted
hashes of its distinct words (64 bits) and longer n-grams (56 bits) with its own counts, split by ranges of
the hash; a range adds up the counts of all chunks and answers each chunk in the order of its hashes. So
a chunk learns the corpus counts of its n-grams in one round trip, every n-gram travels once per chunk
however often it occurs, and a very common one is no heavier than any other. There are as many ranges as
the text's size asks for, so a range's memory stays the same as the corpus grows; a row of the exchange holds at least
one n-gram, so rows never outnumber the n-grams of the chunks.

Of 10**12 distinct n-grams, one in 70,000 shares its hash with another, and their counts are added.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm._common import doc_text, materialize, ship, trim_memory

ORDER = 3
#: Text bytes of a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 8_000_000
#: Bytes that a range is sent, as far as they follow from the bytes of text: about SENT for each order and byte.
RANGE_BYTES = 24_000_000
SENT = 0.45
#: Steps of the doubling scale on which estimates are gathered for expectation-maximisation.
STEPS = 2
ROUNDS = 60
#: Documents by crc32(id) mod 5: this remainder is never learned from ...
HELD_OUT = 1
#: ... and this one is the deleted fold.
DELETED = 4
GOLD, M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ONE = np.uint64(1)
END, BEGIN = b" end", b" begin"  # no word holds a space


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


#: Bits that the keys of n-grams of two or more words leave out; the last bit tells them from words.
SHORT = np.uint64(8)


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) | 1


def squeeze(values: np.ndarray) -> bytes:
    """An array of whole numbers, packed byte plane by byte plane."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def gaps(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand(packed: bytes, kind: type, count: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(packed, max_output_size=max(1, count * size)), np.uint8).reshape(size, count)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


class Chunk:
    """Tokens of some documents and the keys of their n-grams.

    ``levels`` has, for n-grams of each length, the places where they end and, for the distinct ones, their
    keys and which of them stands at each place. A begin stands before the first word of each document; it
    and the histories that end there are counted like n-grams of their length.
    """

    def __init__(self, packed: bytes, order: int):
        self.ids, self.folds, texts = pickle.loads(zstandard.decompress(packed))  # what pack() wrote
        index: dict[bytes, int] = {BEGIN: 0, END: 1}
        pad, streams, lengths = np.zeros(order - 1, np.int32), [], []
        end = np.ones(1, np.int32)
        for text in texts:
            words = text.lower().split()
            for w in set(words).difference(index):
                index[w] = len(index)
            streams += [pad, np.fromiter(map(index.__getitem__, words), np.int32, len(words)), end]
            lengths.append(len(words) + 1)
        del texts
        self.lengths = np.array(lengths, np.int64)
        flat = np.concatenate(streams) if streams else np.empty(0, np.int32)
        del streams
        word_keys = np.fromiter(map(word_key, index), np.uint64, len(index))
        del index
        long = self.lengths + order - 1
        self.doc_of = np.repeat(np.arange(len(long), dtype=np.int32), long)
        offset = np.arange(len(flat)) - (np.cumsum(long) - long)[self.doc_of]
        self.size = len(flat)
        self.tokens = np.flatnonzero(offset >= order - 1)
        self.doc = self.doc_of[self.tokens]
        counted = np.flatnonzero(offset >= order - 2) if order > 1 else self.tokens
        self.levels = [(counted, word_keys, flat[counted])]
        ending = hashes = word_keys[flat]
        for k in range(2, order + 1):
            earlier = np.concatenate((np.zeros(k - 1, np.uint64), hashes[: len(hashes) - k + 1]))
            ending = mix(ending * GOLD + earlier) >> SHORT << SHORT
            places = counted if k < order else self.tokens
            distinct, which = np.unique(ending[places], return_inverse=True)
            self.levels.append((places, distinct, which.astype(np.int32)))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """All distinct keys in order: of words, and of longer n-grams. Histories are n-grams themselves or begins."""
        longer = [keys for _, keys, _ in self.levels[1:]]
        return np.sort(self._met()), np.sort(np.concatenate(longer)) if longer else np.empty(0, np.uint64)

    def _met(self) -> np.ndarray:
        """The keys of words that stand somewhere: the begin and the end are known without that."""
        _, keys, which = self.levels[0]
        return keys[np.bincount(which, minlength=len(keys)) > 0]

    def places(self, words: np.ndarray, longer: np.ndarray) -> list[np.ndarray]:
        """For each level, where its keys stand in the words' keys followed by the longer ones'."""
        out = []
        for level, (_, own, _) in enumerate(self.levels):
            into, base = (longer, len(words)) if level else (words, 0)
            out.append(base + np.minimum(np.searchsorted(into, own), max(len(into) - 1, 0)))
        return out

    def counts(self, words: np.ndarray, longer: np.ndarray, of_doc: np.ndarray) -> np.ndarray:
        total = np.zeros(len(words) + len(longer), np.int64)
        for (places, own, which), into in zip(self.levels, self.places(words, longer)):
            number = np.bincount(which[of_doc[self.doc_of[places]]], minlength=len(own))
            held = np.flatnonzero(number)
            total[into[held]] += number[held]
        return total


def pack(ids: list, folds: list[int], texts: list[bytes]) -> bytes:
    return zstandard.compress(pickle.dumps((ids, folds, texts), 5), 5)


CHUNK = pa.schema([("chunk", pa.int64()), ("deleted", pa.bool_()), ("size", pa.int64()), ("packed", pa.binary())])
MESSAGE = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("words", pa.int64()), ("n", pa.int64()), ("word_keys", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()), ("deleted", pa.bool_())])
ANSWER = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("words", pa.int64()), ("n", pa.int64()), ("kept", pa.binary()), ("whole", pa.binary()), *((f"{a}_{b}", pa.int64()) for a in ("kept", "whole") for b in ("tokens", "types"))])
CHUNK_SQL = "chunk long, deleted boolean, size long, packed binary"
MESSAGE_SQL = "chunk long, part int, words long, n long, word_keys binary, keys binary, counts binary, deleted boolean"
ANSWER_SQL = "chunk long, part int, words long, n long, kept binary, whole binary, kept_tokens long, kept_types long, whole_tokens long, whole_types long"


def chunked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Documents packed into chunks; documents of the deleted fold have chunks of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        held: dict[bool, list] = {True: [[], [], []], False: [[], [], []]}
        size = {True: 0, False: 0}

        def close(deleted: bool) -> pa.RecordBatch:
            nonlocal number
            out = pa.RecordBatch.from_pylist([{"chunk": base + number, "deleted": deleted, "size": size[deleted], "packed": pack(*held[deleted])}], CHUNK)
            number += 1
            held[deleted], size[deleted] = [[], [], []], 0
            return out

        for batch in batches:
            for i, fold, t in zip(*(c.to_pylist() for c in batch.columns)):
                deleted, raw = fold == DELETED, t.encode("utf-8", "surrogatepass")
                if held[deleted][0] and size[deleted] + len(raw) > CHUNK_BYTES:
                    yield close(deleted)
                for column, value in zip(held[deleted], (i, fold, raw)):
                    column.append(value)
                size[deleted] += len(raw)
        for deleted in (True, False):
            if held[deleted][0]:
                yield close(deleted)
        trim_memory()

    key = F.col(f"`{doc_id}`")
    fold = F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5, F.lit(0)).cast("int")
    return docs.select(key.cast("long"), fold, doc_text(text)).mapInArrow(run, CHUNK_SQL)


def sent(chunks: DataFrame, order: int, parts: int) -> DataFrame:
    """Per chunk and range of hashes: the keys of words and of longer n-grams, and the chunk's counts of them in training."""

    def cuts(keys: np.ndarray, bits: int) -> list[int]:
        part = (keys >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)
        return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64)).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number, deleted, packed = (c[row].as_py() for c in batch.columns)
                chunk = Chunk(packed, order)
                words, longer = chunk.keys()
                counts = chunk.counts(words, longer, np.array(chunk.folds) != HELD_OUT).astype(np.uint32)
                short = longer >> SHORT
                a, b = cuts(words, 64), cuts(short, 56)
                rows = []
                for p in range(parts):
                    own, grams = words[a[p] : a[p + 1]], short[b[p] : b[p + 1]]
                    if len(own) or len(grams):
                        counted = np.concatenate((counts[a[p] : a[p + 1]], counts[len(words) + b[p] : len(words) + b[p + 1]]))
                        rows.append({"chunk": number, "part": p, "words": len(own), "n": len(own) + len(grams), "word_keys": gaps(own), "keys": gaps(grams), "counts": squeeze(counted), "deleted": deleted})
                del chunk, words, longer, short
                for at in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 1000], MESSAGE)
        trim_memory()

    return chunks.select("chunk", "deleted", "packed").mapInArrow(run, MESSAGE_SQL)


def answered(sent_: DataFrame) -> DataFrame:
    """Corpus counts of the keys of each chunk and range: of the kept folds, and of all training documents.

    The tokens and types of a range (words only, without the begin) stand in its first row.
    """

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["chunk"])
        known = lambda packed, n: np.cumsum(expand(packed, np.uint64, n), dtype=np.uint64)
        keys = [np.concatenate((known(r["word_keys"], r["words"]), known(r["keys"], r["n"] - r["words"]) << SHORT)) for r in rows]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        bounds = np.cumsum([0, *(len(k) for k in keys)])
        del keys
        kept, cut = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        for k, r in enumerate(rows):  # the keys of a chunk are distinct
            into = cut if r["deleted"] else kept
            into[place[bounds[k] : bounds[k + 1]]] += expand(r["counts"], np.uint32, r["n"])
        whole = kept + cut
        words = ((distinct & ONE) == ONE) & (distinct != np.uint64(word_key(BEGIN)))
        out = []
        for k, r in enumerate(rows):
            own = place[bounds[k] : bounds[k + 1]]
            row = {"chunk": r["chunk"], "part": r["part"], "words": r["words"], "n": r["n"], "kept": squeeze(kept[own]) if r["deleted"] else None, "whole": squeeze(whole[own])}
            for name, c in (("kept", kept), ("whole", whole)):
                row |= {f"{name}_tokens": int(c[words].sum()) if not k else 0, f"{name}_types": int((c[words] > 0).sum()) if not k else 0}
            out.append(row)
        del distinct, place
        trim_memory()
        return pa.Table.from_pylist(out, ANSWER)

    return sent_.groupBy("part").applyInArrow(run, ANSWER_SQL)


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for a history never seen, else 1 more than the whole logarithm of its count."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 0)


class Counted:
    """A chunk with the corpus counts of its n-grams and histories."""

    def __init__(self, packed: bytes, answers: list[dict], column: str, order: int):
        self.chunk = Chunk(packed, order)
        words, longer = self.chunk.keys()
        split: list[list[np.ndarray]] = [[], []]
        for r in sorted(answers, key=lambda r: r["part"]):
            found = expand(r[column], np.int64, r["n"])
            split[0].append(found[: r["words"]])
            split[1].append(found[r["words"] :])
        counts = np.concatenate([*split[0], *split[1]]) if answers else np.empty(0, np.int64)
        if sum(map(len, split[0])) != len(words) or len(counts) != len(words) + len(longer):
            raise ValueError(f"{len(counts)} answers for {len(words)} words and {len(longer)} longer keys")
        self.grams, self.histories = [], []
        before: np.ndarray | None = None
        for (places, _, which), into in zip(self.chunk.levels, self.chunk.places(words, longer)):
            found = counts[into][which] if len(which) else np.empty(0, np.int64)
            flat = np.zeros(self.chunk.size, np.int64)
            flat[places] = found
            self.grams.append(flat[self.chunk.tokens])
            if before is not None:
                self.histories.append(before[self.chunk.tokens - 1])
            before = flat

    def estimates(self, tokens: int, types: int) -> np.ndarray:
        """f_0 to f_order of each token."""
        n = len(self.grams[0])
        rows = [np.full(n, 1.0 / (types + 1)), self.grams[0] / max(tokens, 1)]
        rows += [g / np.maximum(h, 1) for g, h in zip(self.grams[1:], self.histories)]
        return np.stack(rows)

    def buckets(self) -> np.ndarray:
        return bucket(self.histories[-1]) if self.histories else np.ones(len(self.grams[0]), np.int64)


def learn(table: list[tuple], order: int) -> np.ndarray:
    """Weights (bucket, k) from rows (bucket, n, mean log2 f_1 .. f_order or None where 0, f_0): expectation-maximisation per bucket."""
    size = 64
    weights = np.full((size, order + 1), np.nan)
    rows = np.array([[r[0], r[1], *(0.0 if x is None else 2.0**x for x in r[3:])] for r in table], float).reshape(-1, order + 2)
    uniform = table[0][2] if table else 0.0
    for b in np.unique(rows[:, 0]).astype(int):
        own = rows[rows[:, 0] == b]
        f = np.concatenate((np.full((len(own), 1), uniform), own[:, 2:]), axis=1)
        w = np.full(order + 1, 1.0 / (order + 1))
        for _ in range(ROUNDS):
            share = f * w
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
            w = (share * own[:, 1:2]).sum(axis=0) + 1.0  # one pseudo-count: no weight vanishes
            w /= w.sum()
        weights[b] = w
    for b in range(1, size):  # a bucket without held-out counts takes the weights of the one below
        if np.isnan(weights[b]).any():
            weights[b] = weights[b - 1] if not np.isnan(weights[b - 1]).any() else np.full(order + 1, 1.0 / (order + 1))
    if order > 1:  # nothing is known of the longest history
        weights[0] = np.where(np.isnan(weights[0]), 1.0 / order, weights[0])
        weights[0, order] = 0.0
        weights[0] /= weights[0].sum()
    return weights


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    Null texts count as empty: one end token. A row with a null id has remainder 0, so it is learned from.
    Repeated rows are counted and scored as often as they occur; an empty table gives an empty result.
    Words are split at ASCII white space, A-Z in lower case. Ids must be whole numbers of 64 bits. Memory per
    task is bounded by a chunk (or the longest text) or by one range of hashes, of about ``RANGE_BYTES``.
    """
    spark = docs.sparkSession
    ship(spark)
    chunks = materialize(chunked(docs, doc_id, text), "chunks")
    size = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size * SENT * order / RANGE_BYTES))
    answers = materialize(answered(sent(chunks, order, parts)), "answers")
    total = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("kept_tokens", "kept_types", "whole_tokens", "whole_types")]).first()
    answers = answers.select("chunk", "part", "words", "n", "kept", "whole")

    names = [f"q{k}" for k in range(1, order + 1)] + [f"s{k}" for k in range(1, order + 1)]
    seen = pa.schema([("bucket", pa.int64()), ("n", pa.float64()), *((c, pa.int64() if c[0] == "q" else pa.float64()) for c in names)])
    uniform = 1.0 / (total.whole_types + 1)
    kept_tokens, whole_tokens, types = total.kept_tokens, total.whole_tokens, total.whole_types

    def gather(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return seen.empty_table()
        counted = Counted(left.column("packed")[0].as_py(), right.to_pylist(), "kept", order)
        f = counted.estimates(kept_tokens, types)[1:]
        with np.errstate(divide="ignore"):
            log = np.log2(f)
        steps = np.where(f > 0, np.floor(np.where(f > 0, log, 0.0) * STEPS), 1).astype(np.int64)  # 1: no estimate
        packed = counted.buckets()
        for q in steps:
            packed = packed * 1024 + (q + 512)
        distinct, place, number = np.unique(packed, return_inverse=True, return_counts=True)
        columns = [np.bincount(place, np.where(v > 0, lg, 0.0)) for v, lg in zip(f, log)]
        rest, qs = distinct, []
        for _ in range(order):
            qs.insert(0, rest % 1024 - 512)
            rest = rest // 1024
        return pa.Table.from_arrays([pa.array(rest), pa.array(number.astype(float)), *map(pa.array, qs), *map(pa.array, columns)], schema=seen)

    seen_sql = "bucket long, n double, " + ", ".join(f"{c} {'long' if c[0] == 'q' else 'double'}" for c in names)
    held = chunks.filter("deleted").groupBy("chunk").cogroup(answers.filter("kept is not null").groupBy("chunk")).applyInArrow(gather, seen_sql)
    # bounded by the scale: buckets times steps per estimate
    table = held.groupBy("bucket", *names[:order]).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names[order:]]).collect()
    means = [(r["bucket"], r["n"], uniform, *(None if r[f"q{k}"] == 1 else r[f"s{k}"] / r["n"] for k in range(1, order + 1))) for r in sorted(table)]
    weights = learn(means, order)

    def rate(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        counted = Counted(left.column("packed")[0].as_py(), right.to_pylist(), "whole", order)
        chunk = counted.chunk
        f = counted.estimates(whole_tokens, types)
        w = weights[counted.buckets()].T
        with np.errstate(divide="ignore"):
            model = np.log10((f * w).sum(axis=0))
        c = counted.grams[0]
        base = np.log10((c + 0.5) / (whole_tokens + 0.5 * (types + 1)))
        size = len(chunk.ids)
        trim_memory()
        per = lambda x: np.bincount(chunk.doc, x, minlength=size)
        return pa.Table.from_arrays(
            [
                pa.array(chunk.ids, pa.int64()),
                pa.array([fold == HELD_OUT for fold in chunk.folds], pa.bool_()),
                pa.array(chunk.lengths),
                pa.array(per(c > 0).astype(np.int64)),
                pa.array(np.full(size, whole_tokens), pa.int64()),
                pa.array(per(base)),
                pa.array(per(model)),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(rate, result)


def query(docs: DataFrame) -> DataFrame:
    return score(docs)
