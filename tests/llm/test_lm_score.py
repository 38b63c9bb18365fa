import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import lm_score

SCHEMA = "doc_id long, text string, chunk long, score string, held_out string, row string"


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [None]


def corpus(n=60):
    rng = random.Random(9)
    words = ["the", "of", "A", "b", "c", "dé", "E"] + [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(n):
        i, out = 0, []
        for _ in range(rng.randrange(1, 60)):  # words follow from the word before, mostly
            i = (7 * i + 3) % 37 if rng.random() < 0.7 else rng.randrange(37)
            out.append(words[i])
        texts.append(" ".join(out))
    return [(i, t) for i, t in enumerate(texts)] + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (3, texts[3]), (3, texts[3]), (None, "the of")]


def fold(i):
    return 0 if i is None else zlib.crc32(str(i).encode()) % 5


def estimates(rows, order, learned):
    """(row, [f_0 .. f_order], count of the longest history) of every token, from the rows whose fold is in ``learned``; N and the counts of words."""
    counts = [Counter() for _ in range(order + 1)]
    padded = [["<b>"] * (order - 1) + tokens(t) for _, t in rows]
    for (i, _), seq in zip(rows, padded):
        if fold(i) in learned:
            for k in range(1, order + 1):
                for at in range(order - 1 if k == order else order - 2, len(seq)):
                    counts[k][tuple(seq[at - k + 1 : at + 1])] += 1
    words = Counter({w[0]: n for w, n in counts[1].items() if w != ("<b>",)})
    total = sum(words.values())
    out = []
    for row, seq in enumerate(padded):
        for at in range(order - 1, len(seq)):
            grams = [tuple(seq[at - k + 1 : at + 1]) for k in range(1, order + 1)]
            f = [1 / (len(words) + 1), words[seq[at]] / total]
            f += [counts[len(g)][g] / counts[len(g) - 1][g[:-1]] if counts[len(g) - 1][g[:-1]] else 0.0 for g in grams[1:]]
            out.append((row, f, counts[order - 1][grams[-1][:-1]] if order > 1 else 1))
    return out, total, words


def brute(rows, weights, order):
    found, n, words = estimates(rows, order, {0, 2, 3, 4})
    total = Counter()
    for row, f, history in found:
        total[row] += math.log10(sum(x * y for x, y in zip(weights[history.bit_length()], f)))
    out = []
    for row, (i, t) in enumerate(rows):
        seq = tokens(t)
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (len(words) + 1))) for w in seq)
        out.append((-1 if i is None else i, fold(i) == 1, len(seq), sum(words[w] > 0 for w in seq), n, round(base, 6), round(total[row], 6)))
    return sorted(out)


@pytest.fixture()
def kept(monkeypatch):
    found = []
    plain = lm_score.learn
    monkeypatch.setattr(lm_score, "learn", lambda *a: found.append(plain(*a)) or found[-1])
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 500)
    return found


@pytest.mark.parametrize("order", [2, 3])
def test_against_brute_force(spark, kept, order):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "s", "h", "r") for r in rows], SCHEMA)
    scored = lm_score.query(docs) if order == lm_score.ORDER else lm_score.score(docs, order=order)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in scored.collect())
    assert got == brute(rows, kept[0], order)
    held = [g for g in got if g[1]]
    assert held and sum(g[6] for g in held) > sum(g[5] for g in held)
    assert np.allclose(kept[0].sum(axis=1), 1) and kept[0][0, order] == 0
    assert kept[0][5, order] > kept[0][1, order]  # what was seen often weighs more
    assert lm_score.query(docs.limit(0)).count() == 0


def test_binned_estimates_learn_about_the_same_weights(spark, kept):
    rows = corpus(200)
    lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).count()
    found, _, words = estimates(rows, 3, {0, 2, 3})
    held = [(history.bit_length(), f) for row, f, history in found if fold(rows[row][0]) == 4]
    exact = lm_score.learn([(b, 1.0, 1 / (len(words) + 1), *(math.log2(x) if x else None for x in f[1:])) for b, f in held], 3)
    rate = lambda w: sum(math.log10(sum(x * y for x, y in zip(w[b], f))) for b, f in held) / len(held)
    assert abs(rate(exact) - rate(kept[0])) < 0.0005


def test_many_ranges(spark, kept, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lm_score, "RANGE_BYTES", 100)
    assert sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 6)) for r in lm_score.score(docs).collect()) == [(g[0], g[6]) for g in brute(rows, kept[0], 3)]


def test_longer_order_and_long_text(spark, kept):
    rows = [*corpus(20), (500, "the of " * 20_000)]
    docs = spark.createDataFrame([(*r, 1, "s", "h", "r") for r in rows], SCHEMA)
    one, three = ({r.doc_id: r for r in lm_score.score(docs, order=k).collect()} for k in (1, 3))
    assert one[500].n_tokens == three[500].n_tokens == 40_001
    assert three[500].score > one[500].score and one[4].base_score == pytest.approx(three[4].base_score)


def test_weights_of_a_known_mixture():
    rng = np.random.default_rng(0)
    # of words drawn with weights 0.1, 0.3, 0.6 from three sources that share no word
    table = [(3, 1000.0, 0.01, None, None), (3, 3000.0, 0.01, -2.0, None), (3, 6000.0, 0.01, None, -1.0)]
    table = [(b, n * rng.uniform(0.99, 1.01), u, p, q) for b, n, u, p, q in table]
    w = lm_score.learn(table, 2)[3]
    assert abs(w[2] - 0.6) < 0.02 and abs(w[1] - 0.3) < 0.02
