import math
import random
import re
from collections import Counter

from graphloom.llm import divergence_rules as rules

SCHEMA = "doc_id long, text string, lang string, kept boolean, row string, key string, n_words int, class_ref string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def prose(rng, n):
    common = rules.COMMON["en"]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("etaoinshrdlu") for _ in range(6)) for _ in range(n)) + "."


def test_base_counts_and_verdicts(spark):
    rng = random.Random(1)
    texts = [prose(rng, 120) for _ in range(40)]
    texts += [prose(rng, 100).replace(" ", "*** ") + "é #", prose(rng, 90).upper(), "a b c " * 40, "x\ny\nx\n\n \n \nx", "", None, "one two", "\x1c a\x0bb  c", prose(rng, 60) + "\n" + "9" * 300_000]
    rows = [(i, t, "en", True, "r", "k", 1, "c") for i, t in enumerate(texts)] + [(None, texts[0], None, None, None, None, None, None)] * 2
    out = rules.judge(spark.createDataFrame(rows, SCHEMA))
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        expected = brute(r.row.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
    kept = {r.row.doc_id: r.kept for r in got if r.row.doc_id is not None}
    assert all(kept[i] for i in range(40))
    assert not any(kept[i] for i in range(40, 47))
    assert rules.query(spark.createDataFrame([], SCHEMA)).count() == 0


def class_shares(text):
    marks = {".,;:!?'\"()-": 5}
    out = [0] * len(rules.CLASSES)
    for c in text:
        code = ord(c)
        if "a" <= c <= "z":
            k = 0
        elif "A" <= c <= "Z":
            k = 1
        elif code < 128 and c.isdigit():
            k = 3
        elif c == " " or 9 <= code <= 13:
            k = 4
        elif any(c in m for m in marks):
            k = 5
        elif 33 <= code <= 126:
            k = 6
        elif code >= 128 and c.isalpha():
            k = 2
        elif code >= 128 and c.isspace():
            k = 4
        else:
            k = 7
        out[k] += 1
    return [x / len(text) for x in out]


def word_shares(text):
    order = sorted({w for ws in rules.COMMON.values() for w in ws})
    out, words = [0] * (len(order) + 1), WORD.findall(text)
    for w in words:
        w = "".join(c.lower() if c.isascii() else c for c in w)
        w = w if w in order else w[:-1] if w[-1] in ".,;:!?" else w
        out[order.index(w) if w in order else -1] += 1
    return [x / len(words) for x in out]


def js(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    return math.sqrt(sum((x * math.log2(x / c) if x else 0) + (y * math.log2(y / c) if y else 0) for x, y, c in zip(p, q, m)) / 2)


def centre(rows):
    middle = [sorted(column)[(len(rows) - 1) // 2] for column in zip(*rows)]
    return [x / sum(middle) for x in middle]


def test_verdicts_by_brute_force(spark):
    rng = random.Random(3)
    texts = [(rng.choice(["en", "fr", None]), prose(rng, rng.randrange(20, 150))) for _ in range(120)]
    texts += [("en", " ".join(w + rng.choice(["", "%%", "$"]) for w in prose(rng, 80).split())) for _ in range(20)]
    texts += [("en", " ".join("".join(rng.choice("aeiou") for _ in range(5)) for _ in range(90))) for _ in range(10)] + [("fr", "1 2 3 " * 30), ("en", "Ab " * 10), ("de", prose(rng, 60)), ("en", "é" * 150 + " " + prose(rng, 55))]
    rows = [(i, t, lang) for i, (lang, t) in enumerate(texts)]
    base = {i: brute(t) for i, t, _ in rows}
    failed = {i: b[0] < 50 or 100 * b[4] > 50 * b[0] for i, b in base.items()}
    expected = {}
    for lang in {lang for _, _, lang in rows}:
        own = [(i, t) for i, t, x in rows if x == lang]
        good = [(i, t) for i, t in own if not failed[i]]
        by_class = [class_shares(t) for _, t in good if len(t) >= rules.MIN_CHARS]
        by_word = [word_shares(t) for i, t in good if base[i][0] >= rules.MIN_WORDS]
        for i, t in own:
            a = js(class_shares(t), centre(by_class)) if by_class and len(t) >= rules.MIN_CHARS else 0.0
            b = js(word_shares(t), centre(by_word)) if by_word and base[i][0] >= rules.MIN_WORDS else 0.0
            both = a > rules.BOTH_CLASS_DISTANCE and b > rules.BOTH_WORD_DISTANCE + rules.WORD_SLACK / math.sqrt(max(base[i][0], 1))
            expected[i] = not failed[i] and a <= rules.MAX_CLASS_DISTANCE and b <= rules.MAX_WORD_DISTANCE and not both
    got = {r.doc_id: r.kept for r in rules.query(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == expected
    assert sum(expected.values()) > 60 and sum(not failed[i] and not k for i, k in expected.items()) > 5


def test_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(rules.distance(F.col("p"), F.col("q")).alias("d"), rules.distance(F.col("p"), F.col("p")).alias("z")).first()
    assert abs(row.d - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-12 and row.z == 0
