"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans. Base kinds (email, ip, card, phone) follow a fixed contract and always
stay. Further kinds (secrets, national phone numbers, national ids, account numbers, titled names)
are only proposed: four labelers (shape, gazetteer, context, surroundings) vote on every span for,
against or not at all. Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is for each kind; what it has seen little of a kind leans on all kinds. Without an
anchor its two classes could be any two, so base spans count as nearly surely personal. The resulting labels
train a logistic classifier on votes, kind and form (length, share of digits), and a proposed span stays if the
classifier finds it more likely than not. The counts of patterns are bounded (kinds times 3 to the power
of the labelers times the forms), so the driver fits both.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm._common import doc_text, materialize

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "tel", "natid", "account", "person")
KINDS = (*BASE, *EXTRA)
LABELERS = ("shape", "gazetteer", "context", "surroundings")

# What the contract's patterns match. They are written so that the engine neither backtracks
# over nor restarts inside a run of characters: a match starts where a run starts or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[ ]?[=:][ ]?\"?[A-Za-z0-9+/_.-]{6,}+",
    "tel": r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "natid": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.? \p{Lu}\p{Ll}{1,30}(?: \p{Lu}\p{Ll}{1,30})?",
}
#: Cheap tests of whether a text can hold a match at all.
GUARDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"(?:[0-9][ -]?+){16}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "secret": lambda t: F.contains(t, F.lit("=")) | F.contains(t, F.lit(":")),
    "tel": lambda t: t.rlike(r"[0-9]{3}[ .-][0-9]{4}"),
    "natid": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
    "account": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
    "person": lambda t: t.rlike(r"(?:Mr|Mrs|Ms|Dr|Prof)\.? "),
}
# Vocabularies of the labelers.
CUES = {
    "email": "mail contact write reach address",
    "ip": "ip host server address ping from login",
    "card": "card visa credit pay payment account number",
    "phone": "phone tel call mobile fax contact number",
    "secret": "password passwd pwd secret token key login credential user",
    "tel": "phone tel call mobile fax contact number",
    "natid": "ssn social security id number tax",
    "account": "iban account bank transfer pay",
    "person": "by from dear signed author contact",
}
AGAINST = r"(?i)\b(?:version|isbn|issn|doi|order|invoice|page|fig|figure|section|chapter|example|sample|placeholder|dummy)\b[^0-9A-Za-z]*$"
PLACEHOLDER = r"(?i)^(?:password|your|changeme|example|x+|\*+|0+|1234567890?|none|null|true|false|localhost)$|^(?:0\.0\.0\.0|127\.|255\.|192\.0\.2\.|198\.51\.100\.|203\.0\.113\.)|^(?:no-?reply|postmaster|example|test)@|^000|^666|^[A-Z]{2}00"
# What a value holds that is known to be in use: domains, issuers, country codes, key prefixes, given names.
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|int|info|io|eu|uk|de|fr|es|it|nl|ch|at|be|pl|ca|us)$",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1-6]|9[0-58])",
    "secret": r"^(?:AKIA|gh[pousr]_|sk[-_]|xox[abp]-|eyJ)",
    "tel": r"^\(?[2-9](?!11)[0-9]{2}",
    "account": r"^(?:AD|AT|BE|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK)",
    "person": r"(?i)\b(?:james|john|robert|michael|william|david|mary|patricia|linda|elizabeth|anna|maria|peter|thomas|paul|marie|jean|pierre|hans|juan|jose|carmen|laura|sarah)\b",
}
#: Probability that a base span is personal, for the label model.
ANCHOR = 0.95
#: How many spans' worth of all kinds stand behind a kind's own counts.
SHARED = 20.0
#: Upper bounds of the classes of length and of the share of digits.
LENGTHS = (12, 24, 48)
DIGITS = (0.2, 0.6)
SHAPE = {
    "email": r"\.[A-Za-z]{2,24}$",
    "ip": r"^[1-9][0-9]{0,2}(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^[3-6]",
    "phone": r"^\+[1-9]",
    "secret": r"^(?=[^0-9]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])[A-Za-z0-9+/_.-]{12,}+$",
    "tel": r"^\(?[2-9]",
    "natid": r"^(?!9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "account": r"^(?=(?:[^0-9]*[0-9]){10})",
    "person": r"^(?:Mr|Mrs|Ms|Dr|Prof)\. ",
}
#: Spans gathered at a time.
BLOCK = 128
#: Code points of context on either side.
CONTEXT = 40
SPAN = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.IntegerType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("value", T.StringType()),
            T.StructField("before", T.StringType()),
            T.StructField("after", T.StringType()),
        ]
    )
)
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def luhn(digits: F.Column) -> F.Column:
    """Whether a string of digits passes the Luhn sum."""

    def term(i: F.Column) -> F.Column:
        d = F.ascii(F.substr(digits, -i, F.lit(1))) - 48
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    return F.aggregate(places, F.lit(0), lambda s, i: s + term(i)) % 10 == 0


def valid(kind: str, value: F.Column) -> F.Column | None:
    """What a match of a base kind must hold besides its pattern."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return None


def holds(kind: str):
    return lambda s: valid(kind, s["value"])


def of_kind(number: int):
    return lambda s: s["kind"] == number


def pieces(gaps: F.Column, values: F.Column) -> F.Column:
    """Matches, each with the gap before and the gap after it."""
    zipped = F.arrays_zip(values.alias("value"), gaps.alias("gap"), F.slice(gaps, F.lit(2), F.size(values)).alias("next"))
    return F.slice(zipped, F.lit(1), F.size(values))


def spans_of(kind: str, found: F.Column) -> F.Column:
    """Spans of the matches ``found``, with their places in code points.

    Places are running sums. An array that grows in an aggregate is copied at every step, so spans are
    gathered in blocks, and the blocks in a list.
    """
    number = F.lit(KINDS.index(kind))
    empty = F.array().cast(SPAN)

    def step(state: F.Column, z: F.Column) -> F.Column:
        start = state["at"] + F.length(z["gap"])
        end = start + F.length(z["value"])
        span = F.struct(number.alias("kind"), start.alias("start"), end.alias("end"), z["value"].alias("value"), F.right(z["gap"], F.lit(CONTEXT)).alias("before"), F.left(z["next"], F.lit(CONTEXT)).alias("after"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def block(state: F.Column, first: F.Column) -> F.Column:
        own = F.aggregate(F.slice(found, first, F.lit(BLOCK)), F.struct(state["at"].alias("at"), empty.alias("spans")), step)
        return F.transform(F.array(own), lambda o: F.struct(o["at"].alias("at"), F.concat(state["blocks"], F.array(o["spans"])).alias("blocks")))[0]

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(T.ArrayType(SPAN)).alias("blocks"))
    whole = F.flatten(F.aggregate(F.sequence(F.lit(1), F.size(found), F.lit(BLOCK)), begin, block)["blocks"])
    return F.when(F.size(found) > 0, whole).otherwise(empty)


def propose(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """``row`` with all base spans that hold and all further spans that touch no base span.

    Each pattern runs in a projection of its own, below the one that uses its matches: inside a lambda
    it would run again for every match.
    """
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), doc_text(text).alias("text"))
    columns = []
    for kind in KINDS:
        pattern, guard = PATTERNS[kind], GUARDS[kind](F.col("text"))
        columns.append(F.when(guard, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias(f"v_{kind}"))
    matched = source.select("row", "text", *columns)
    cut = [F.when(F.size(f"v_{kind}") > 0, F.split("text", PATTERNS[kind], -1)).alias(f"g_{kind}") for kind in KINDS]
    matched = matched.select("row", *[f"v_{kind}" for kind in KINDS], *cut)
    matched = matched.select("row", *[pieces(F.col(f"g_{kind}"), F.col(f"v_{kind}")).alias(f"p_{kind}") for kind in KINDS])
    spans = {kind: spans_of(kind, F.col(f"p_{kind}")) for kind in KINDS}
    base = [spans[kind] if kind == "email" else F.filter(spans[kind], holds(kind)) for kind in BASE]
    found = matched.select("row", F.concat(*base).alias("base"), F.concat(*[spans[kind] for kind in EXTRA]).alias("extra"))
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return found.select("row", "base", F.filter("extra", free).alias("extra"))


def votes(span: F.Column) -> list[F.Column]:
    """Votes of the labelers on a span: 1 for, -1 against, 0 none."""
    kind, value, before, after = span["kind"], span["value"], span["before"], span["after"]
    bare = F.when(kind == KINDS.index("secret"), F.regexp_extract(value, r"([A-Za-z0-9+/_.-]+)$", 1)).otherwise(value)

    def by_kind(make) -> F.Column:
        out = F.lit(False)
        for i, name in enumerate(KINDS):
            out = F.when(kind == i, make(name)).otherwise(out)
        return out

    shape = F.when(by_kind(lambda k: bare.rlike(SHAPE[k])), 1).otherwise(-1)
    known = by_kind(lambda k: bare.rlike(GAZETTEER[k]) if k in GAZETTEER else F.lit(False))
    gazetteer = F.when(bare.rlike(PLACEHOLDER), -1).when(known, 1).otherwise(0)
    around = F.concat(before, F.lit(" "), F.when(kind == KINDS.index("secret"), value).otherwise(F.lit("")))
    cue = by_kind(lambda k: F.lower(around).rlike(rf"(?:^|[^a-z])(?:{CUES[k].replace(' ', '|')})"))
    context = F.when(before.rlike(AGAINST), -1).when(cue, 1).otherwise(0)
    clean = (before.rlike(r"(?:^|[\s\"'(\[<:=,;])$")) & (after.rlike(r"^(?:$|[\s\"')\]>,;.!?])"))
    return [shape, gazetteer, context, F.when(clean, 1).otherwise(-1)]


def form(span: F.Column) -> list[F.Column]:
    """Classes of the length and of the share of digits of a span's value."""
    size = F.length(span["value"])
    digits = F.length(F.regexp_replace(span["value"], "[^0-9]", "")) / F.greatest(size, F.lit(1))

    def place(x: F.Column, bounds: tuple) -> F.Column:
        return sum(((x > b).cast("int") for b in bounds), F.lit(0))

    return [place(size, LENGTHS), place(digits, DIGITS)]


#: A span's inputs to the classifier: its votes, one place for each kind and each class of form, and a bias.
WIDTHS = (len(KINDS), len(LENGTHS) + 1, len(DIGITS) + 1)


def inputs(kind: int, votes_: tuple[int, ...], forms: tuple[int, ...]) -> list[float]:
    out = [float(v) for v in votes_]
    for value, width in zip((kind, *forms), WIDTHS):
        out += [float(value == i) for i in range(width)]
    return [*out, 1.0]


def label_model(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> tuple[dict, list[list[float]]]:
    """(kind, votes, count) -> probability of each (kind, votes), and the reliabilities of the labelers over all kinds.

    Expectation-maximisation: a hidden label per span; given it and the kind, the labelers vote independently of
    each other. It starts from the majority of votes; base kinds stay at ``ANCHOR``.
    """
    majority = lambda v: 0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else 0.5
    posterior = {(k, v): ANCHOR if k < len(BASE) else majority(v) for k, v, _ in patterns}
    labelers, table = range(len(LABELERS)), np.zeros(0)
    for _ in range(rounds):
        # maximisation: of each labeler P(vote | label), with two pseudo-counts for the right side and one for each vote
        counts = np.zeros((len(KINDS), len(LABELERS), 2, 3))
        prior = np.ones((len(KINDS), 2))
        for k, v, n in patterns:
            p = posterior[k, v]
            prior[k] += n * (1 - p), n * p
            for j in labelers:
                counts[k, j, :, v[j] + 1] += n * (1 - p), n * p
        whole = counts.sum(axis=0) + np.array([[3.0, 1.0, 1.0], [1.0, 1.0, 3.0]])
        table = whole / whole.sum(axis=2, keepdims=True)
        own = counts + SHARED * table
        log = np.log(own / own.sum(axis=3, keepdims=True))
        side = np.log(prior / prior.sum(axis=1, keepdims=True))
        # expectation
        for k, v, _ in patterns:
            if k >= len(BASE):
                for_, against = (side[k, y] + sum(log[k, j, y, v[j] + 1] for j in labelers) for y in (1, 0))
                posterior[k, v] = float(1 / (1 + np.exp(min(700.0, against - for_))))
    return posterior, [[float(x) for x in table[j].ravel()] for j in labelers]


def fit(patterns: list[tuple[int, tuple[int, ...], tuple[int, ...], int]]) -> tuple[dict, list[list[float]], list[float]]:
    """(kind, votes, form, count) -> probabilities of the label model, reliabilities, weights of the classifier.

    The classifier is a logistic regression on the label model's probabilities, by gradient ascent with a quadratic penalty.
    """
    totals: dict[tuple, int] = {}
    for k, v, _, n in patterns:
        totals[k, v] = totals.get((k, v), 0) + n
    posterior, table = label_model([(k, v, n) for (k, v), n in sorted(totals.items())])
    if not patterns:
        return posterior, table, [0.0] * (len(LABELERS) + sum(WIDTHS) + 1)
    x = np.array([inputs(k, v, f) for k, v, f, _ in patterns])
    target, n = np.array([posterior[k, v] for k, v, _, _ in patterns]), np.array([float(n) for *_, n in patterns])
    weights = np.zeros(x.shape[1])
    for _ in range(2000):
        error = target - 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        weights += 0.5 * ((n * error) @ x / n.sum() - 0.001 * weights)
    return posterior, table, weights.tolist()


def detect(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` with ``spans``: (kind, start, end, value, probability, base), by kind as in ``KINDS``, then start.

    Null texts count as empty and have no spans. Repeated rows stay repeated; an empty table gives an
    empty result. Places are code points, end exclusive. The classifier learns from the spans of all
    documents; only the counts of vote patterns reach the driver. Base spans stay whatever it finds.
    """
    carry = docs.columns if carry is None else carry
    found = materialize(propose(docs, text, carry), "spans")
    both = F.concat("base", "extra")
    span = F.col("s")
    ballots = found.select(F.explode(both).alias("s")).select(F.col("s.kind").alias("kind"), F.array(*votes(span)).alias("votes"), F.array(*form(span)).alias("form")).groupBy("kind", "votes", "form").count()
    _, _, weights = fit(sorted((r["kind"], tuple(r["votes"]), tuple(r["form"]), r["count"]) for r in ballots.collect()))
    by_vote, bias, rest = weights[: len(LABELERS)], weights[-1], weights[len(LABELERS) : -1]
    tables = [F.lit(rest[sum(WIDTHS[:i]) : sum(WIDTHS[: i + 1])]) for i in range(len(WIDTHS))]

    def judged(base: bool):
        def one(s: F.Column) -> F.Column:
            score = F.lit(bias)
            for w, v in zip(by_vote, votes(s)):
                score = score + F.lit(w) * v
            for table, place in zip(tables, (s["kind"], *form(s))):
                score = score + F.get(table, place)
            return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), (1 / (1 + F.exp(-score))).alias("probability"), F.lit(base).alias("base"))

        return one

    kept = F.filter(F.transform("extra", judged(False)), lambda s: s["probability"] >= 0.5)
    return found.select("row", F.array_sort(F.concat(F.transform("base", judged(True)), kept)).alias("spans"))


def listed(spans: F.Column) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(docs: DataFrame) -> DataFrame:
    found = detect(docs, carry=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select(F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def let(value: F.Column, body) -> F.Column:
    """``body`` of ``value``, which is worked out once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def disjoint(spans: F.Column) -> F.Column:
    """Spans by place as (start, end, kind), none before the end of an earlier one: of an overlap the later keeps the rest.

    What is left of a span may be empty; such spans go. Gathered in blocks, as in ``spans_of``.
    """
    part = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end", "kind")]))

    def step(state: F.Column, s: F.Column) -> F.Column:
        own = F.struct(F.greatest(state["at"], s["start"]).alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["end"] > state["at"], F.concat(state["spans"], F.array(own))).otherwise(state["spans"]).alias("spans"))

    def gathered(placed: F.Column) -> F.Column:
        def block(state: F.Column, first: F.Column) -> F.Column:
            own = F.aggregate(F.slice(placed, first, F.lit(BLOCK)), F.struct(state["at"].alias("at"), F.array().cast(part).alias("spans")), step)
            return let(own, lambda o: F.struct(o["at"].alias("at"), F.concat(state["blocks"], F.array(o["spans"])).alias("blocks")))

        begin = F.struct(F.lit(0).alias("at"), F.array().cast(T.ArrayType(part)).alias("blocks"))
        return F.flatten(F.aggregate(F.sequence(F.lit(1), F.size(placed), F.lit(BLOCK)), begin, block)["blocks"])

    return let(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), gathered)


def count_until(spans: F.Column, holds) -> F.Column:
    """How many of the first spans hold: those that do come first, so the steps halve."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, k: F.when(n + k <= F.size(spans), F.when(holds(F.try_element_at(spans, n + k)), n + k).otherwise(n)).otherwise(n))


#: Code points of text that are cut at a time; a place is found by counting from the start of its part.
PART = 4096


def redacted(text: F.Column, spans: F.Column) -> F.Column:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the later one covers only the rest.

    The text is taken in parts, each with the spans that reach into it, and joined once: time grows in
    proportion to the text and its spans. A null text, and one without spans, stays as it is.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def whole(spans: F.Column) -> F.Column:
        def part(piece: F.Column, i: F.Column) -> F.Column:
            begin = i * PART
            first = count_until(spans, lambda s: s["end"] <= begin)
            last = count_until(spans, lambda s: s["start"] < begin + F.length(piece))

            def step(state: F.Column, s: F.Column) -> F.Column:
                gap = F.substr(piece, state["at"] - begin + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
                name = F.when(s["start"] >= begin, F.element_at(names, s["kind"] + 1)).otherwise(F.lit(""))
                return F.struct(s["end"].alias("at"), F.concat(state["out"], gap, name).alias("out"))

            done = F.aggregate(F.slice(spans, first + 1, last - first), F.struct(begin.alias("at"), F.lit("").alias("out")), step)
            return let(done, lambda d: F.concat(d["out"], F.substr(piece, d["at"] - begin + 1, F.greatest(F.length(piece) - (d["at"] - begin), F.lit(0)))))

        pieces_ = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
        return F.array_join(F.transform(pieces_, part), "")

    return F.when(F.size(spans) > 0, let(disjoint(spans), whole)).otherwise(text)
