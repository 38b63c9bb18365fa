"""Near-duplicates with ProbMinHash signatures, banding and exact verification.

ProbMinHash: each shingle of a text is a Poisson process whose rate is its weight, the number of its
occurrences. Its arrivals fall on random registers; a register keeps the shingle of its first arrival.
The share of equal registers estimates the probability Jaccard similarity J_P of two texts. Arrivals are
made in order of time and only up to the time at which every register is taken (early termination): a text
takes one arrival per shingle and about k log k further ones for k registers.

Two texts are linked if J_P of their weighted shingles or the Jaccard similarity of their shingle sets is
at least the limit. With equal weights J_P is the similarity of the sets, so a text that repeats shingles is
signed twice, as weighted and as a set; other texts have one signature for both. Neither kind of link
depends on the other's signature.

Texts are grouped first by equality, so that copies stand for one text. Texts that agree on a band of
registers meet in a bucket. Verification takes two steps, both exact and both in blocks of bounded size:

1. Each bucket's least id is its hub. The texts that meet a hub are split into blocks, the hub with each,
   and all similarities in a block are computed. Where a hub has one block, its buckets are done.
2. Of the other buckets, those whose texts are of one class by now are done as well. In the rest, texts
   outside the bucket's largest class are compared with each other and with that class, block by block.

So a large group of near copies costs in proportion to its size, no pair becomes a row, and each pair of a
bucket that isn't linked by way of others has been compared. Classes are the connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm._common import discard, doc_text, join_by_share, materialize, ship, trim_memory

WORDS = 5
SIMILARITY = 0.8
#: At similarity 0.8 a pair shares no band with a probability of about 1 in 20,000.
BANDS = 25
ROWS = 5
#: Texts and shingles of a block, on average.
BLOCK = 256
BLOCK_SHINGLES = 1_000_000
#: Columns of the incidence matrix that are multiplied at a time.
COLUMNS = 4096
#: Characters of text whose shingles are worked on at a time.
SLICE_CHARS = 4_000_000

M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64: a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words; ``known`` holds those met before."""
    import xxhash

    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words; a shorter text is one shingle."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    out = np.full(n, np.uint64(width))
    for j in range(width):
        out = mix(out * GOLD + hashes[j : j + n])
    return out


def text_shingles(texts: list[str], width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of each text and how often they occur."""
    known: dict[bytes, int] = {}
    return [np.unique(shingle_hashes(word_hashes(t.encode("utf-8", "surrogatepass").split(), known), width), return_counts=True) for t in texts]


def signatures(weighted: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """ProbMinHash signatures, one row of ``k`` registers per text; a text without shingles has zeros.

    Time is cut into windows. In a window, all texts whose registers aren't all taken continue the
    processes of their shingles up to the window's end; a text ends with the window that takes its
    last register, as no later arrival can be a first one.
    """
    count = len(weighted)
    out = np.zeros((count, k), np.uint64)
    total = np.array([w.sum() for _, w in weighted], np.float64) if count else np.empty(0)
    best = np.full((count, k), np.inf)
    open_ = np.flatnonzero(total > 0)
    if not len(open_):
        return out
    owner = np.concatenate([np.full(len(s), i) for i, (s, _) in enumerate(weighted)]).astype(np.int64)
    element = np.concatenate([s for s, _ in weighted]).astype(np.uint64)
    weight = np.concatenate([w for _, w in weighted]).astype(np.float64)
    clock = np.zeros(len(element))
    state = element.copy()

    def advance(who: np.ndarray) -> np.ndarray:
        """The next arrival of each process: its register; the clock moves by an exponential time."""
        state[who] = mix(state[who] + GOLD)
        r = mix(state[who] ^ M1)
        u = ((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        clock[who] -= np.log(u) / weight[who]
        return (mix(state[who] ^ M2) % np.uint64(k)).astype(np.int64)

    register = advance(np.arange(len(element)))
    limit = np.zeros(count)
    step = np.zeros(count)
    step[open_] = k * (np.log(k) + 2.0) / total[open_]
    is_open = np.zeros(count, bool)
    is_open[open_] = True
    while is_open.any():
        limit = np.where(is_open, limit + step, limit)
        due = np.flatnonzero(is_open[owner] & (clock <= limit[owner]))
        while len(due):
            text, place, time = owner[due], register[due], clock[due]
            flat = text * k + place
            # of the arrivals at one register now, the first in time; equal times go to the smaller shingle
            order = np.lexsort((element[due], time, flat))
            flat, time, what = flat[order], time[order], element[due][order]
            first = np.concatenate(([True], flat[1:] != flat[:-1]))
            flat, time, what = flat[first], time[first], what[first]
            sooner = time < best.ravel()[flat]
            best.ravel()[flat[sooner]] = time[sooner]
            out.ravel()[flat[sooner]] = what[sooner]
            register[due] = advance(due)
            due = due[clock[due] <= limit[owner[due]]]
        is_open &= np.isinf(best).any(axis=1)
    return out


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE_CHARS):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def keys_of(weighted: list[tuple[np.ndarray, np.ndarray]], bands: int, rows: int) -> np.ndarray:
    signed = signatures(weighted, bands * rows).reshape(len(weighted), bands, rows)
    keys = np.zeros((len(weighted), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        keys = mix(keys * GOLD + signed[:, :, j])
    return keys.view(np.int64)


def band_keys(texts: list[str], width: int, bands: int, rows: int) -> tuple[list[list[int]], list[int]]:
    """Keys of the bands of each text, and its number of distinct shingles; texts without words have no keys."""
    out: list[list[int]] = []
    sizes: list[int] = []
    for at, end in slices(texts):
        own = list(dict.fromkeys(texts[at:end]))
        found = text_shingles(own, width)
        plain = keys_of([(s, np.ones(len(s))) for s, _ in found], bands, rows).tolist()
        repeats = [i for i, (_, n) in enumerate(found) if len(n) and n.max() > n.min()]
        for i, more in zip(repeats, keys_of([found[i] for i in repeats], bands, rows).tolist()):
            plain[i] = list(dict.fromkeys(plain[i] + more))
        listed = {t: (plain[i] if len(found[i][0]) else [], len(found[i][0])) for i, t in enumerate(own)}
        for t in texts[at:end]:
            out.append(listed[t][0])
            sizes.append(listed[t][1])
    return out, sizes


def keyed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(id, copy, size, keys): copy is the digest of the text, size its number of shingles, keys those of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys, sizes = band_keys(batch.column(2).to_pylist(), width, bands, rows)
                columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "copy", "size", "keys"])
        trim_memory()

    schema = T.StructType([docs.schema["id"], T.StructField("copy", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    return docs.select("id", "copy", "text").mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, shingles, times): the distinct shingle hashes of each text, packed, and their counts where they differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, end in slices(texts):
                found = text_shingles(texts[at:end], width)
                sets = [s.tobytes() for s, _ in found]
                times = [n.astype(np.uint32).tobytes() if len(n) and n.max() > n.min() else None for _, n in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(sets, pa.binary()), pa.array(times, pa.binary())], names=["id", "shingles", "times"])
        trim_memory()

    fields = [docs.schema["id"], T.StructField("shingles", T.BinaryType()), T.StructField("times", T.BinaryType())]
    return docs.select("id", "text").mapInArrow(run, T.StructType(fields))


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, enough: float = 0.0) -> float:
    """J_P of two weighted sets (sorted shingles, weights): the sum over shared i of 1 / sum over j of max(x_j / x_i, y_j / y_i).

    The j with x_j / y_j above x_i / y_i take the first side of the maximum, so the j are put in order of that
    ratio. 0 if an upper bound, the mass that the two have in common, is under ``enough``.
    """
    x, y = x / x.sum(), y / y.sum()
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    u, v = x[i], y[j]
    if not len(u) or np.minimum(u, v).sum() < enough:
        return 0.0
    ratio = u / v
    order = np.argsort(ratio, kind="stable")
    u, v, ratio = u[order], v[order], ratio[order]
    above = 1.0 - np.cumsum(u) + u  # the mass of x from here on, with what only x has
    under = np.cumsum(v) - v + (1.0 - v.sum())  # the mass of y before, with what only y has
    return float((1.0 / (above / u + under / v)).sum())


def similar(sets: list[np.ndarray], times: list[np.ndarray | None], similarity: float) -> np.ndarray:
    """Links (row pairs) of which all follow: sets with a Jaccard similarity of ``similarity`` or more, as a square of booleans.

    Pairs linked by J_P alone are added unless the sets' links join them already.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(n), size.astype(np.int64))
    weights = [np.ones(len(s), np.float32) if t is None else t.astype(np.float32) for s, t in zip(sets, times)]
    mass = np.concatenate([w / w.sum() if len(w) else w for w in weights])
    weighted = any(t is not None for t in times)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owner, column, mass = owner[shared], column[shared], mass[shared]
    both, common = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    if len(column):
        order = np.argsort(column, kind="stable")
        owner, mass = owner[order], mass[order]
        column = np.unique(column[order], return_inverse=True)[1]
        width = int(column[-1]) + 1
        for at in range(0, width, COLUMNS):
            a, b = np.searchsorted(column, (at, at + COLUMNS))
            part = np.zeros((n, min(COLUMNS, width - at)), np.float32)
            part[owner[a:b], column[a:b] - at] = 1
            both += part @ part.T
            if weighted:
                share = np.zeros_like(part)
                share[owner[a:b], column[a:b] - at] = mass[a:b]
                common += share @ part.T
    links = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-6
    links &= both > 0
    if weighted:
        repeats = np.array([t is not None for t in times])
        # neither text has less than J_P of its mass in shingles of the other
        near = (np.minimum(common, common.T) >= similarity - 1e-4) & ~links & (repeats[:, None] | repeats[None, :])
        label = forest(links)
        for i, j in zip(*np.nonzero(np.triu(near, 1))):
            if label[i] != label[j] and probability_jaccard(sets[i], weights[i], sets[j], weights[j], similarity - 1e-4) >= similarity - 1e-9:
                links[i, j] = links[j, i] = True
                label[label == max(label[i], label[j])] = min(label[i], label[j])
    return links


def forest(links: np.ndarray) -> np.ndarray:
    """For each row the first row of its component."""
    n = len(links)
    label = np.arange(n)
    while True:
        least = np.where(links, label[None, :], n).min(axis=1)
        least = np.minimum(label, least)
        if (least == label).all():
            return label
        label = least


def linked(members: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """(a, b): a spanning forest of the links within each block (rows with equal ``keys``) of members(id, shingles, times)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        if group.num_rows < 2:
            return schema.empty_table()
        ids = np.array(group.column("id").to_pylist(), np.int64)
        order = np.argsort(ids, kind="stable")
        packed, counted = group.column("shingles").to_pylist(), group.column("times").to_pylist()
        sets = [np.frombuffer(packed[i], np.uint64) for i in order.tolist()]
        times = [None if counted[i] is None else np.frombuffer(counted[i], np.uint32) for i in order.tolist()]
        ids = ids[order]
        label = forest(similar(sets, times, similarity))
        joined = np.flatnonzero(label != np.arange(len(ids)))
        return pa.Table.from_arrays([pa.array(ids[label[joined]]), pa.array(ids[joined])], schema=schema)

    return members.groupBy(*keys).applyInArrow(run, "a long, b long").filter("a != b").distinct()


def blocks_of(number: F.Column, size: F.Column) -> F.Column:
    """How many blocks a group of ``number`` texts with ``size`` shingles takes."""
    return F.greatest(F.ceil(number / BLOCK), F.ceil(size / BLOCK_SHINGLES), F.lit(1)).cast("int")


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (id, label) after the edges (a, b) are added: each class takes the smallest label in it.

    Contracts the graph of labels. In each step a label hooks onto the neighbour that comes first in a
    random order of that step, takes that one's hook for its own, and links are renamed. About a constant
    share of the labels goes in each step, so steps grow with the logarithm of their number.
    """
    of = lambda side: labels.select(F.col("id").alias(side), F.col("label").alias(f"l{side}"))
    links = edges.join(of("a"), "a").join(of("b"), "b").filter("la != lb").select(F.least("la", "lb").alias("u"), F.greatest("la", "lb").alias("v")).distinct()
    current = materialize(links, "links")
    roots: DataFrame | None = None
    turn = 0
    while current.head(1):
        rank = lambda c, turn=turn: F.struct(F.xxhash64(c, F.lit(turn)).alias("r"), F.col(c).alias("n"))
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.min(rank("v")).alias("m")).select(F.col("u").alias("node"), F.least(rank("u"), "m")["n"].alias("parent"))
        up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        step = materialize(hook.join(up, "parent").select("node", "root"), "hook")
        if roots is None:
            roots = materialize(step, "roots")
        else:
            moved = roots.join(step.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left")
            before, roots = roots, materialize(moved.select("node", F.coalesce("new", "root").alias("root")), "roots")
            discard(before)
        renamed = current.join(step.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u").join(step.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v")
        before, current = current, materialize(renamed.filter("ru != rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "links")
        discard(before, step)
        turn += 1
    discard(current)
    if roots is None:
        return labels
    smallest = roots.groupBy("root").agg(F.min("node").alias("to"))
    moved = roots.join(smallest, "root").select(F.col("node").alias("label"), "to")
    joined = materialize(labels.join(moved, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
    discard(roots)
    return joined


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = WORDS,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """(doc_id, class_id) for each row: class_id is the smallest id of the row's class of near-duplicates.

    Words are split at ASCII white space and compared as they are. A text of fewer than ``width`` words
    is one shingle. A null text counts as empty; empty texts are copies of each other, as all equal texts
    are, and near-duplicates of nothing else. A row with a null id is a class of its own (null). Repeated
    ids: the id stands for all its texts, so their classes are one, and each row comes back. An empty
    table gives an empty result. Ids must be whole numbers of 64 bits.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), doc_text(text).alias("text"))
    given = source.filter("id is not null").select("id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("copy"), "text")
    seen = materialize(keyed(given, width, bands, rows), "signatures")
    total = seen.count()
    # copies: one id stands for each text, and one label for all texts of an id
    first = materialize(seen.groupBy("copy").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "first")
    copies = materialize(join_by_share(seen.select("id", "copy"), first, "copy", "n", total).select("id", "rep"), "copies")
    labels = first.select(F.col("rep").alias("id")).distinct().select("id", F.col("id").alias("label"))
    shared = copies.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a != b")
    labels = materialize(labels, "labels")
    if shared.head(1):
        extra = copies.join(shared.select("id", "a"), "id").filter("rep != a").select("a", F.col("rep").alias("b"))
        labels = components(extra, labels)
    # an id stands for a text once; it brings all texts that it stands for
    stands = seen.join(first.select("copy", F.col("rep").alias("id")), ["copy", "id"], "left_semi").dropDuplicates(["copy", "id"])
    buckets = materialize(stands.select("id", "size", F.explode("keys").alias("key")), "buckets")
    hubs = buckets.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top"), F.count(F.lit(1)).alias("n")).filter("hub != top")
    met = materialize(join_by_share(buckets, materialize(hubs, "hubs"), "key", "n", total).select("key", "hub", "id", "size"), "met")
    candidates = first.select("copy", F.col("rep").alias("id")).join(met.select("id").distinct(), "id", "left_semi")
    texts = given.join(candidates, ["copy", "id"], "left_semi").dropDuplicates(["copy", "id"]).select("id", "text")
    sets = materialize(shingle_sets(texts, width), "sets", "lz4")

    # each hub with the texts that meet it
    pairs = met.select("hub", "id", "size").distinct()
    load = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), blocks_of(F.count(F.lit(1)), F.sum("size")).alias("blocks"))
    load = materialize(load, "load")
    block = F.when(F.col("id") == F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    placed = join_by_share(pairs.select("hub", "id"), load, "hub", "n", total).select("hub", "id", F.explode(block).alias("block")).distinct()
    labels = components(linked(placed.join(sets, "id"), ["hub", "block"], similarity), labels)

    # buckets of hubs with several blocks, where classes are left that haven't met
    several = load.filter("blocks > 1").select("hub")
    if several.head(1):
        inside = materialize(met.join(several, "hub", "left_semi").select("key", "id", "size").join(labels, "id"), "inside")
        classes = inside.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
        whole = classes.groupBy("key").agg(F.max_by("label", "n").alias("core"), F.max("n").alias("n"), F.max_by("size", "n").alias("size"), F.sum("n").alias("all"), F.sum("size").alias("all_size"))
        whole = whole.filter("n < all").select("key", "core", blocks_of(F.col("n"), F.col("size")).alias("cores"), blocks_of(F.col("all") - F.col("n"), F.col("all_size") - F.col("size")).alias("rests"))
        inside = inside.join(whole, "key")
        place = F.xxhash64("id")
        is_core = F.col("label") == F.col("core")
        own = F.when(is_core, F.col("rests") + F.pmod(place, F.col("cores"))).otherwise(F.pmod(place, F.col("rests"))).cast("int")
        others = F.sequence(F.lit(0), F.col("rests") - 1 + F.when(is_core, 0).otherwise(F.col("cores")))
        inside = inside.select("key", "id", own.alias("own"), F.explode(others).alias("other"))
        blocks = inside.select("key", "id", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).distinct()
        labels = components(linked(blocks.join(sets, "id"), ["key", "lo", "hi"], similarity), labels)

    whole = copies.join(labels.select(F.col("id").alias("rep"), "label"), "rep").select("id", "label")
    by_id = whole.groupBy("id").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("n"))
    repeated = by_id.select(F.col("id").alias("doc_id"), F.col("label").alias("class_id"), F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("i")).drop("i")
    nulls = source.filter("id is null").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"))
    result = repeated.unionByName(nulls)
    discard(seen, first, buckets, met, sets, load)
    return result


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
