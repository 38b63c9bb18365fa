import hashlib
import random
import re

from pyspark.sql import functions as F

from graphloom.llm import weak_pii

SCHEMA = "doc_id long, text string, spans string, base string, row string, n_email int"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def texts():
    rng = random.Random(5)
    parts = ["a@b.cc", "a@b.c_d@e.ff", "x.y%z@mail.example.com.", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.002.03.4", "4041894974608795", "4041 8949-7460 8795", "404189497460879", "+1 (626) 555-5759", "+1(((", "+12", "é\U0001f600", " ", "\n", "@", ".", "-", "+", "9", "00", "password=b7db7aa4a5fcc78305", 'token = "1beb58b8af68854f"', "Dr. Jane Roe", "078-05-1120", "GB82 WEST 1234 5698 7654 32"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    return [*out, None, "", *long_texts(1)]


def long_texts(k):
    return ["x" * 2000 * k, "1" * 1000 * k, "1.2.3." * 200 * k, "a@b" * 300 * k, "+1" + "(" * 1000 * k, "a@" + "b." * 500 * k, "mail a@b.cc " * 30 * k]


def test_base_spans(spark):
    rows = [(i, t, "s", "b", "r", 1) for i, t in enumerate(texts())] + [(None, "a@b.cc", None, None, None, None)] * 2
    got = weak_pii.query(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, text, *_ in rows:
        expected, r = brute(text), by_id[i]
        assert r.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest(), (i, expected[:5], r.spans[:200])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(e.startswith(k + ":") for e in expected) for k in PLAIN]
        assert not set(expected) - set(r.spans.split(","))
    assert weak_pii.query(spark.createDataFrame([], SCHEMA)).count() == 0
    # a hundred times as long: plain backtracking would take hours
    long = spark.createDataFrame([(i, t, "s", "b", "r", 1) for i, t in enumerate(long_texts(100))], SCHEMA)
    assert {r.doc_id: (r.n_email, r.n_ip) for r in weak_pii.query(long).collect()}[6] == (3000, 0)


def test_added_spans_and_redaction(spark):
    rows = [(i, f"The password=b7db7aa4a5fcc7830{i % 10} is here, mail a{i}@b.cc or call.", "", "", "", 1) for i in range(30)]
    rows += [(100, 'is password="xxxxxx"', "", "", "", 1)]
    found = weak_pii.detect(spark.createDataFrame(rows, SCHEMA))
    out = {r.row.doc_id: r for r in found.withColumn("text", weak_pii.redacted(F.col("row.text"), F.col("spans"))).collect()}
    assert out[3].text == "The [SECRET] is here, mail [EMAIL] or call."
    assert out[100].text == 'is password="xxxxxx"'
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_secrets_are_redacted_whole(spark):
    token = "eyJhbGciOiJIUzI1NiJ9." + "aZ09_-+/" * 34 + ".b7db7aa4"
    sizes = [(token[:n], n) for n in (127, 128, 129, 300)] + [("b7" * 500_000, 1_000_000)]
    rows = [(i, f"The password=b7db7aa4a5fcc7830{i % 10} is here.", "", "", "", 1) for i in range(30)]
    rows += [(100 + i, f"set token: {value} here", "", "", "", 1) for i, (value, _) in enumerate(sizes)]
    rows += [(200, f"set token: {'a' * 1_000_000} here", "", "", "", 1)]  # no digit: the shape must not be tried from every place
    found = weak_pii.detect(spark.createDataFrame(rows, SCHEMA))
    out = {r.row.doc_id: r for r in found.withColumn("text", weak_pii.redacted(F.col("row.text"), F.col("spans"))).collect()}
    for i, (_, size) in enumerate(sizes):
        assert out[100 + i].text == "set [SECRET] here"
        assert [(s.start, s.end) for s in out[100 + i].spans] == [(4, 11 + size)]
    assert all((s.start, s.end) == (4, 11 + 1_000_000) for s in out[200].spans)


def test_label_model_finds_the_reliable_labeler():
    rng = random.Random(2)
    counts = {}
    for _ in range(4000):
        y = rng.random() < 0.5
        right = lambda p: (1 if y else -1) * (1 if rng.random() < p else -1)
        v = (right(0.95), right(0.8), right(0.85), right(0.55))
        counts[v] = counts.get(v, 0) + 1
    kind = weak_pii.KINDS.index("tel")
    posterior, table, weights = weak_pii.fit([(kind, v, (0, 0), n) for v, n in sorted(counts.items())])
    reliability = [t[5] for t in table]
    assert reliability[0] > 0.9 and reliability[0] > reliability[2] > reliability[1] > reliability[3] and reliability[3] < 0.62
    assert weights[0] > weights[2] > weights[3] and posterior[kind, (1, 1, 1, 1)] > 0.99


def test_added_spans_against_planted_ones(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("etaoin") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    token = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "a7"
    personal = [
        lambda: f"password={token(20)}",
        lambda: f'api_key: "{token(32)}',
        lambda: f"call (2{digits(2)}) {digits(3)}-{digits(4)}",
        lambda: f"phone {rng.randrange(301, 800)}-{digits(3)}-{digits(4)}",
        lambda: f"ssn {rng.randrange(101, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}",
        lambda: f"iban DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}",
        lambda: f"signed Dr. {rng.choice(['Maria', 'Peter', 'Xaver'])} {word().title()}",
    ]
    harmless = [lambda: "password=changeme", lambda: "token: xxxxxxxx", lambda: f"order 0{digits(2)}-{digits(3)}-{digits(4)}", lambda: f"version 1{digits(2)} {digits(3)} {digits(4)}x", lambda: f"isbn 000-{digits(2)}-{digits(4)}", lambda: f"invoice XX00 {digits(4)} {digits(4)} {digits(4)}."]
    rows = [(i, f"{prose(8)} {rng.choice(personal)()} {prose(5)}") for i in range(300)] + [(1000 + i, f"{prose(8)} {rng.choice(harmless)()} {prose(5)}") for i in range(150)]
    rows += [(2000 + i, f"{prose(5)} a{i}.{word()}@mail.{word()}.com {prose(5)} 10.{rng.randrange(1, 200)}.3.7 {prose(3)}") for i in range(100)] + [(3000 + i, prose(30)) for i in range(100)]
    found = weak_pii.detect(spark.createDataFrame(rows, "doc_id long, text string"))
    hit = {r.doc_id for r in found.select("row.doc_id", F.size(F.filter("spans", lambda s: ~s["base"])).alias("n")).filter("n > 0").collect()}
    planted, false = {i for i in hit if i < 1000}, {i for i in hit if i >= 1000}
    assert len(planted) >= 0.95 * 300 and len(false) <= 0.05 * len(hit), (len(planted), len(false))


def spread(rng, n):
    text = "".join(rng.choice("abé\n😀 x") for _ in range(n))
    spans = [(rng.randrange(9), s, min(n, s + rng.choice([1, 3, 5, 10, 6000]))) for s in (rng.randrange(n) for _ in range(n // 40))]
    return text, spans


def replaced(text, spans):
    at, out = 0, []
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        out.append(text[at : max(start, at)])
        if end > at:
            out.append(f"[{weak_pii.KINDS[kind].upper()}]")
        at = max(at, end)
    return "".join(out) + text[at:]


def test_redaction_of_many_spans_against_brute_force(spark):
    rng = random.Random(3)
    rows = [spread(rng, n) for n in (1, 5, 300, 9000, 20_000)]
    rows += [("", []), ("x" * 500_000, [(i % 9, 10 * i + 2, 10 * i + 7) for i in range(50_000)])]
    schema = "text string, spans array<struct<kind:int,start:int,end:int,value:string,probability:double,base:boolean>>"
    docs = spark.createDataFrame([(t, [(k, s, e, "", 0.0, True) for k, s, e in found]) for t, found in rows], schema)
    got = [r[0] for r in docs.select(weak_pii.redacted(F.col("text"), F.col("spans"))).collect()]
    assert got == [replaced(t, found) for t, found in rows]
