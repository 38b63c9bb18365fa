"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words are compared with
references of its language by Jensen-Shannon distance. References are robust centres of the corpus
itself: per language the median share of every class or word, over all documents that are long
enough and pass the base rules. Documents under a minimum length aren't judged by a histogram,
since a short text's histogram says little.

Two limits follow. Where most documents of a language that pass the base rules are junk, junk is the reference;
a caller who expects that hands in a corpus in which it isn't so. In a language without a list of common
words nearly all words are others, so that only the characters tell.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm._common import join_by_share, materialize, with_results

#: Classes of characters, in this order: a-z, A-Z, other letters, digits, white space, sentence marks, other ASCII marks, anything else.
CLASSES = ("lower", "upper", "letter", "digit", "space", "stop", "mark", "other")
# Common words of the four languages. A histogram has one place for each and one for all other words.
COMMON = {
    "en": "the of and to in a is that it for was on are with as be by this at from or have an not which he you they".split(),
    "fr": "de la le et les des en un une du que est pour qui dans par sur au plus ne pas avec ce il se son aux ou".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an für er sie aus bei nach".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha".split(),
}
#: Bins of a share, from 0 to 1.
BINS = 16_384
MIN_CHARS = 200
MIN_WORDS = 50
#: Either distance alone rejects beyond these ...
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.60
#: ... and both together beyond these; a histogram of n words strays from its source by about 1 / sqrt(n).
BOTH_CLASS_DISTANCE = 0.17
BOTH_WORD_DISTANCE = 0.15
WORD_SLACK = 1.25
SYMBOLS = str.maketrans("", "", "#*$%&|<>")
ASCII_CLASS = np.array([0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c == 32 or 9 <= c <= 13 else 5 if chr(c) in ".,;:!?'\"()-" else 6 if 33 <= c <= 126 else 7 for c in range(128)], np.uint8)
LETTER = re.compile(r"[^\W\d_]")
FIELDS = [
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars")),
    T.StructField("class_counts", T.ArrayType(T.LongType())),
    T.StructField("word_counts", T.ArrayType(T.LongType())),
]


def words_of(text: bytes) -> list[bytes]:
    return text.split()  # bytes split at 0x09-0x0D and 0x20 only


def repeated(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    if len(index) == n:
        return 0
    size = len(index)
    if size < 2_000_000:
        key = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:  # ranks of pairs, so that keys stay within 64 bits
        key = np.unique(ids[:-2] * size + ids[1:-1], return_inverse=True)[1] * size + ids[2:]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    if len(set(lines)) == len(lines):
        return 0
    seen: set[str] = set()
    found = 0
    for line in lines:
        if line in seen:
            found += bool(line.encode("utf-8", "surrogatepass").split())
        else:
            seen.add(line)
    return found


def class_histogram(text: str) -> list[int]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = codes < 128
    out = np.bincount(ASCII_CLASS[codes[plain]], minlength=len(CLASSES))
    if not plain.all():
        rest, number = np.unique(codes[~plain], return_counts=True)
        for code, k in zip(rest.tolist(), number.tolist()):
            char = chr(code)
            out[2 if LETTER.match(char) else 4 if char.isspace() else 7] += k
    return out.tolist()


def word_histogram(words: list[bytes], common: dict[bytes, int]) -> list[int]:
    n = len(set(common.values()))
    return np.bincount(np.fromiter(map(common.get, words, repeat(n)), np.int64, len(words)), minlength=n + 1).tolist()


def features(docs: DataFrame, text: str, common: dict[str, list[str]], carry: list[str] | None) -> DataFrame:
    order = sorted({w for ws in common.values() for w in ws})
    index = {form: i for i, w in enumerate(order) for form in {w.encode(), *((w + e).encode() for e in ".,;:!?")}}

    def run(texts: list[str]) -> list[pa.Array]:
        rows = []
        for t in texts:
            raw = t.encode("utf-8", "surrogatepass")
            words = words_of(raw)
            symbols = len(t) - len(t.translate(SYMBOLS)) if t.isascii() else sum(map(t.count, "#*$%&|<>"))
            blanks = sum(map(t.count, " \t\n\x0b\x0c\r"))
            rows.append((len(words), len(t) - blanks, symbols, duplicate_lines(t), repeated(words), len(t), class_histogram(t), word_histogram(raw.lower().split(), index)))
        columns = list(zip(*rows))
        return [pa.array(c, pa.int64() if k < 6 else pa.list_(pa.int64())) for k, c in enumerate(columns)]

    return with_results(docs, text, run, FIELDS, carry)


def shares(counts: str, total: F.Column) -> F.Column:
    return F.transform(F.col(counts), lambda x: x / total)


def distance(p: F.Column, q: F.Column) -> F.Column:
    """Jensen-Shannon distance with logarithms to base 2: 0 for equal distributions, 1 for disjoint ones."""

    def half(a: F.Column, m: F.Column) -> F.Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: half(a, (a + b) / 2) + half(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def binned(judged: DataFrame, size: int, min_chars: int, min_words: int) -> DataFrame:
    """(key, place, bin, n, total) per batch of judged(key, n_chars, n_words, class_counts, word_counts): how many documents have a
    share of that bin, and the sum of their shares. Places are the classes, then the ``size`` words."""
    every = len(CLASSES) + size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).dictionary_encode()
            of = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            sides, first = [], 0
            for total, counts, least in ((1, 3, min_chars), (2, 4, min_words)):
                size = batch.column(total).to_numpy(zero_copy_only=False).astype(np.float64)
                table = np.asarray(batch.column(counts).flatten()).reshape(batch.num_rows, -1)
                long = size >= max(least, 1)
                share = table[long] / size[long, None]
                places = table.shape[1]
                level = np.minimum((share * BINS).astype(np.int64), BINS - 1)
                sides.append((((of[long, None] * every + first + np.arange(places)) * BINS + level).ravel(), share.ravel()))
                first += places
            flat, share = (np.concatenate(x) for x in zip(*sides))
            cell, place, n = np.unique(flat, return_inverse=True, return_counts=True)
            head, level = np.divmod(cell, BINS)
            key, at = np.divmod(head, every)
            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(key)), pa.array(at.astype(np.int32)), pa.array(level.astype(np.int32)), pa.array(n), pa.array(np.bincount(place, share, len(cell)))], names=["key", "place", "bin", "n", "total"])

    return judged.select("key", "n_chars", "n_words", "class_counts", "word_counts").mapInArrow(run, "key string, place int, bin int, n long, total double")


def references(judged: DataFrame, size: int, min_chars: int, min_words: int) -> DataFrame:
    """(key, class_ref, word_ref): the median share of each place over the documents of a key, each histogram scaled to sum 1.

    Shares are counted in bins, so that the sums of all documents spread over keys, places and bins and combine
    before they travel; of a place's median bin the mean share is taken, off by less than 1 / ``BINS``. What is left per
    key and place is bounded by the bins.
    """
    cells = binned(judged, size, min_chars, min_words).groupBy("key", "place", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    whole = Window.partitionBy("key", "place")
    ranked = cells.withColumn("upto", F.sum("n").over(whole.orderBy("bin"))).withColumn("all", F.sum("n").over(whole))
    middle = ranked.filter((F.col("upto") >= F.col("all") / 2) & (F.col("upto") - F.col("n") < F.col("all") / 2))
    medians = middle.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", (F.col("total") / F.col("n")).alias("m")))).alias("all"))
    one = lambda classes: F.transform(F.filter("all", lambda x: (x["place"] < len(CLASSES)) == classes), lambda x: x["m"])
    sides = medians.select("key", one(F.lit(True)).alias("class_ref"), one(F.lit(False)).alias("word_ref"))

    def scaled(c: str, places: int) -> F.Column:
        total = F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x)
        return F.when((F.size(c) == places) & (total > 0), F.transform(F.col(c), lambda x: x / total)).alias(c)

    return sides.select(F.col("key").alias("ref_key"), scaled("class_ref", len(CLASSES)), scaled("word_ref", size))


def judge(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    common: dict[str, list[str]] = COMMON,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
    max_class: float = MAX_CLASS_DISTANCE,
    max_words: float = MAX_WORD_DISTANCE,
    both_class: float = BOTH_CLASS_DISTANCE,
    both_words: float = BOTH_WORD_DISTANCE,
    word_slack: float = WORD_SLACK,
    carry: list[str] | None = None,
) -> DataFrame:
    """Each row of ``docs`` (struct ``row``) with its base counts, both distances, ``base_failed`` and ``kept``.

    ``carry`` names the columns that ``row`` keeps (all by default; the language is always among them).

    Null texts count as empty; a null language is a language of its own. A document under
    ``min_chars`` characters or ``min_words`` words has no distance of that kind (null) and isn't
    rejected by it; nor is one whose language has no reference. Repeated rows stay repeated; an empty
    table gives an empty result. Documents don't travel, but for those of languages with under a thousandth of all
    rows: counts of shares are shuffled.
    """
    size = len({w for ws in common.values() for w in ws}) + 1
    if carry is not None and lang in docs.columns:
        carry = [*dict.fromkeys([*carry, lang])]
    seen = features(docs, text, common, carry)
    language = F.coalesce(F.col(f"row.`{lang}`").cast("string"), F.lit("")) if lang in docs.columns else F.lit("")
    seen = seen.withColumn("key", language)
    seen = materialize(seen, "features")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    seen = seen.withColumn("base_failed", failed)
    chars, words = F.col("n_chars"), F.col("n_words")
    long_enough = {"class": chars >= max(min_chars, 1), "word": words >= max(min_words, 1)}
    good = seen.filter(~F.col("base_failed"))
    own = references(good, size, min_chars, min_words)
    # a row per language; a common one is broadcast, so that its documents, text and all, stay where they are
    languages = seen.groupBy("key").agg(F.count(F.lit(1)).alias("of_key")).join(own, F.col("key") == F.col("ref_key"), "left")
    refs = materialize(languages.select("key", "of_key", "class_ref", "word_ref"), "references")
    out = join_by_share(seen, refs, "key", "of_key", refs.agg(F.coalesce(F.sum("of_key"), F.lit(0))).first()[0])
    out = out.withColumns(
        {
            "class_distance": F.when(long_enough["class"], distance(shares("class_counts", chars), F.col("class_ref"))),
            "word_distance": F.when(long_enough["word"], distance(shares("word_counts", words), F.col("word_ref"))),
        }
    )
    by_class, by_word = F.coalesce("class_distance", F.lit(0.0)), F.coalesce("word_distance", F.lit(0.0))
    both = (by_class > both_class) & (by_word > both_words + word_slack / F.sqrt(F.greatest("n_words", F.lit(1))))
    passed = (by_class <= max_class) & (by_word <= max_words) & ~both
    return out.withColumn("kept", ~F.col("base_failed") & passed).drop("key", "of_key", "n_chars", "class_ref", "word_ref", "class_counts", "word_counts")


def query(docs: DataFrame) -> DataFrame:
    return judge(docs, carry=["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"
    )
