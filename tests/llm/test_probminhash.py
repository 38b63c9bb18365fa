import random
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import probminhash

SCHEMA = "doc_id long, text string, id string, label string, key string, class_id string, row string"


def shingles(text):
    words = (text or "").encode().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def jaccard(a, b):
    return len(a.keys() & b.keys()) / len(a.keys() | b.keys())


def weighted(a, b):
    """Probability Jaccard by its definition."""
    a, b = ({k: n / sum(c.values()) for k, n in c.items()} for c in (a, b))
    either = a.keys() | b.keys()
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in either) for i in a.keys() & b.keys())


def brute(rows, limit=0.8):
    rows = [(i, t or "") for i, t in rows if i is not None]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, t, shingles(t)) for i, t in rows]
    for k, (i, t, s) in enumerate(sets):
        for j, u, v in sets[:k]:
            if t == u or s and v and (jaccard(s, v) >= limit or max([*s.values(), *v.values()]) > 1 and jaccard(s, v) > 0 and weighted(s, v) >= limit):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, find(i)) for i, _ in rows)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    texts = []
    for _ in range(n):
        base = [word() for _ in range(rng.randrange(1, 200))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 25) + 1)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            base = copy  # chains: the first and the last may be far apart
    rng.shuffle(texts)
    return [(10 + i, t) for i, t in enumerate(texts)]


def run(spark, rows):
    out = probminhash.near_duplicates(spark.createDataFrame([(i, t, "i", "l", "k", "c", "r") for i, t in rows], SCHEMA))
    return sorted(((r.doc_id, r.class_id) for r in out.collect()), key=str)


def test_classes_as_by_brute_force(spark):
    rows = corpus(4)
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_repeats_do_not_hide_a_link(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    rows = []
    for k, times in enumerate((20, 24, 24, 60, 100, 100, 400)):
        body, line = " ".join(word() for _ in range(300)), " " + " ".join(word() for _ in range(12))
        rows += [(2 * k, body + line), (2 * k + 1, body + line * times)]
    assert brute(rows) == [(i, i - i % 2) for i in range(14)]
    assert run(spark, rows) == sorted(brute(rows), key=str)


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(probminhash, "BLOCK", 4)


def test_groups_of_several_blocks(spark, small_blocks):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows, base = [], [word() for _ in range(200)]
    for _ in range(60):  # near copies, from a base that drifts away
        base[rng.randrange(200)] = word()
        rows.append(" ".join(base))
    for _ in range(40):  # texts that share a passage meet without being similar
        own = [word() for _ in range(20)]
        rows += [" ".join(passage + own), " ".join(passage + own[:-1] + [word()])]
    rng.shuffle(rows)
    rows = [(i, t) for i, t in enumerate(rows)]
    assert len({c for _, c in brute(rows)}) > 20
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_links_by_weight_alone(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    rows = []
    for k in range(12):  # a repeated line outweighs what differs
        line = " ".join(word() for _ in range(8))
        for j in range(2):
            rows.append((2 * k + j, " ".join([line] * rng.choice([30, 31, 40]) + [word() for _ in range(3 + 6 * k)])))
    expected = brute(rows)
    linked = [i for i, c in expected if i != c]
    assert 3 < len(linked) < 12
    assert any(jaccard(shingles(rows[i][1]), shingles(rows[i - 1][1])) < 0.8 for i in linked)
    assert run(spark, rows) == sorted(expected, key=str)


def test_probability_jaccard_by_its_definition():
    rng = random.Random(13)
    for _ in range(200):
        a, b = (Counter(rng.randrange(12) for _ in range(rng.randrange(1, 40))) for _ in range(2))
        pack = lambda c: (np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)], float))
        assert abs(probminhash.probability_jaccard(*pack(a), *pack(b)) - weighted(a, b)) < 1e-9


def test_edges(spark):
    same = "one two three four five six seven eight nine ten"
    rows = [(5, same), (3, same), (5, same), (7, None), (8, ""), (9, "  \n"), (11, "a b"), (12, "a  b"), (None, same), (None, None), (20, "q w e r t z u"), (20, same), (21, "q w e r t z u"), (30, "x " * 100_000)]
    expected = brute([r for r in rows if r[0] not in (9,)])
    got = run(spark, rows)
    assert [g for g in got if g[0] not in (9, None)] == sorted(expected, key=str)
    assert (9, 9) in got and got.count((None, None)) == 2
    assert run(spark, []) == []


def test_estimate_and_scale_of_weights():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 60, 500).astype(np.uint64))
    b = np.concatenate((a[100:], rng.integers(0, 1 << 60, 100).astype(np.uint64)))
    weight = rng.integers(1, 9, 600).astype(float)
    x, y = weight[: len(a)], np.concatenate((weight[100 : len(a)], weight[500:600][:100]))
    one = probminhash.signatures([(a, x), (b, y), (a, 3 * x)], 2000)
    px, py = x / x.sum(), y / y.sum()
    both = len(a) - 100
    exact = 0.0
    for i in range(both):
        u, v = px[100 + i], py[i]
        ratio_x, ratio_y = px / u, py / v
        exact += 1 / (np.maximum(ratio_x[100:], ratio_y[:both]).sum() + ratio_x[:100].sum() + ratio_y[both:].sum())
    assert abs((one[0] == one[1]).mean() - exact) < 0.04
    assert (one[0] == one[2]).all()  # only the proportions of the weights count


def test_long_chain_is_one_class(spark):
    n = 300
    labels = spark.range(n).selectExpr("id", "id as label")
    edges = spark.range(n - 1).selectExpr("id as a", "id + 1 as b")
    assert {r.label for r in probminhash.components(edges, labels).collect()} == {0}
