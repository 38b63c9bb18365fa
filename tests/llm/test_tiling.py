import random

import numpy as np

from graphloom.llm import tiling

DOCS = "doc_id long, text string, leaks string, row string, found string"


def brute(item, text, least):
    """Longest free common run first, until none of ``least`` is left."""
    a, b, covered = [False] * len(item), [False] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return covered
        k, i, j = best
        a[i : i + k] = [True] * k
        b[j : j + k] = [True] * k
        covered += k


def test_tiles_are_as_long_as_brute_force_finds():
    rng = random.Random(3)
    for _ in range(150):
        item = [rng.randrange(1, 12) for _ in range(rng.randrange(5, 25))]
        parts = [item[i : i + 6] for i in range(0, len(item), 6)]
        rng.shuffle(parts)
        text = [x for p in parts for x in [*p, *(rng.randrange(12) for _ in range(rng.randrange(3)))]]
        tiles = tiling.greedy_tiles(np.array(item), np.array(text), 4)
        lengths = [t[2] for t in tiles]
        assert lengths == sorted(lengths, reverse=True)
        for i, j, k in tiles:
            assert item[i : i + k] == text[j : j + k]
        used = [p for i, _, k in tiles for p in range(i, i + k)]
        assert len(used) == len(set(used))
        first = brute(item, text, 4)
        assert (sum(lengths) > 0) == (first > 0)
        if first:
            assert abs(sum(lengths) - first) <= 4  # ties between equally long matches may fall otherwise


def tiles_of(item, text, least):
    """Tiles by the definition: the longest run first, of equal ones that with the smaller item place, then text place."""
    a, b, tiles = [False] * len(item), [False] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return tiles
        a[i : i + k] = [True] * k
        b[j : j + k] = [True] * k
        tiles.append((i, j, k))


def test_tiles_equal_the_definition():
    rng = random.Random(4)
    for _ in range(200):
        item = [rng.randrange(1, 8) for _ in range(rng.randrange(3, 30))]
        text = [rng.randrange(1, 8) for _ in range(rng.randrange(0, 20))] + rng.sample([item[:9], item[9:20], item[20:]], 3)[0] + [rng.randrange(1, 8) for _ in range(20)]
        least = rng.randrange(2, 6)
        assert tiling.greedy_tiles(np.array(item), np.array(text), least) == tiles_of(item, text, least)


def test_query_by_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 4)))
    items = [(k, [word() for _ in range(rng.choice([2, 4, 12, 25, 40]))]) for k in range(12)]
    docs = []
    for i in range(40):
        item = rng.choice(items)[1]
        cut = rng.randrange(len(item) + 1)
        parts = [item[cut:], item[:cut], [word() for _ in range(rng.randrange(30))], rng.choice(items)[1][: rng.randrange(1, 20)]]
        rng.shuffle(parts)
        docs.append((i, [w for p in parts for w in p]))
    expected = []
    for i, text in docs:
        for k, item in items:
            tiles = tiles_of(item, text, min(5, len(item)))
            matched = sum(t[2] for t in tiles)
            if tiles and matched >= 0.6 * len(item):
                expected.append((i, k, len(tiles), matched, len(item), matched / len(item)))
    frame = lambda rows, names: spark.createDataFrame([(i, " ".join(t)) for i, t in rows], names)
    got = tiling.query(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected) and len(expected) > 40


def test_rows(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    moved = "x Seven eight nine, ten eleven twelve y z one two three four five six."
    rows = [(1, moved), (2, "one two three four"), (3, None), (4, ""), (None, item), (5, "tiny item here"), (6, moved), (6, moved)]
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], DOCS)
    bench = spark.createDataFrame([(7, item), (8, "Tiny item"), (9, ""), (None, None)], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.n_tiles, r.coverage) for r in tiling.query(docs, bench).collect())
    assert got == [(0, 7, 1, 1.0), (1, 7, 2, 1.0), (5, 8, 1, 1.0), (6, 7, 2, 1.0), (6, 7, 2, 1.0)]
    marked = tiling.mark_leaks(docs, bench, block_chars=20)  # an item a block
    assert sorted(len(r.leaks) for r in marked.collect()) == [0, 0, 0, 1, 1, 1, 1, 1]
    assert marked.select("row.*").columns == docs.columns
    assert tiling.query(docs.limit(0), bench).count() == 0 == tiling.query(docs, bench.limit(0)).count()
