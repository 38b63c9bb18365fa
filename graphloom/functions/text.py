"""Text functions from columns to columns, on the JVM wherever Spark has the function."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Line breaks, as a text is split into lines, and reference marks such as [3] or [2-4].
LINE_BREAKS = r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
REFERENCE = r"\[[0-9]+(?:-[0-9]+)?\]"
BLANKS = r"[ \t\r\f\u000b]+"
#: What makes a text more than one clean line: breaks, blanks that aren't one space, reference marks.
UNCLEAN = r"[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029\t\u00a0\u3000\[]|  "
SENTENCE_END = "。！？!?；;"
#: Characters stripped from both ends of a name when it is cleaned.
NAME_EDGES = " \t\r\n\"'“”‘’[]【】()（）:：,，.。;；!！?？、"


@pandas_udf(StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    """Character references decoded. Spark has no such function; texts without "&" don't come here."""
    return text.map(lambda t: None if t is None else html.unescape(t))


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark lacks."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def let(value: F.Column, use) -> F.Column:
    """``use`` of a value that is worked out once, however often it is used; a plain column would be copied into each use."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def clean_text(text: F.Column, unescape=None) -> F.Column:
    """No reference marks, blank runs as one space, lines trimmed and blank lines dropped; null gives an empty text."""
    text = F.coalesce(text, F.lit(""))
    if unescape is not None:
        return cleaned_lines(unescape(text))
    # most short texts (headings, names, lines) have nothing to clean but their ends
    return F.when(text.rlike(UNCLEAN), cleaned_lines(text)).otherwise(F.trim(text))


def cleaned_lines(text: F.Column) -> F.Column:
    text = F.translate(text, " 　", "  ")
    text = F.regexp_replace(text, REFERENCE, "")
    lines = F.split(text, LINE_BREAKS, -1)
    tidy = F.transform(lines, lambda line: F.trim(F.regexp_replace(line, BLANKS, " ")))
    return F.array_join(F.filter(tidy, lambda line: line != ""), "\n")


def sentences(text: F.Column, ends: str = SENTENCE_END) -> F.Column:
    """Sentences of each line: cut after an end mark, trimmed, blank ones dropped."""
    marks = "".join(f"\\{c}" if c in "\\]^-[" else c for c in ends)
    cut = F.flatten(F.transform(F.split(text, "\n", -1), lambda line: F.split(line, f"(?<=[{marks}])", -1)))
    return F.filter(F.transform(cut, lambda x: F.trim(x)), lambda s: s != "")


def short_evidence(text: F.Column, limit: int = 180) -> F.Column:
    whole = F.trim(F.regexp_replace(text, r"[\n]+", " "))
    return let(whole, lambda one: F.when(F.length(one) > limit, F.concat(F.substring(one, 1, limit), F.lit("..."))).otherwise(one))


def strip(text: F.Column, chars: str) -> F.Column:
    """``chars`` removed from both ends."""
    return F.btrim(text, F.lit(chars))


def term_name(text: F.Column) -> F.Column:
    """A candidate term without brackets, marks, one lead-in and one ending (each once, so not idempotent)."""
    name = F.regexp_replace(F.regexp_replace(clean_text(text), r"^[（(【\[]+", ""), r"[）)】\]]+$", "")
    name = F.regexp_replace(strip(name, TERM_EDGES), TERM_LEADS, "")
    return strip(F.regexp_replace(name, TERM_ENDS, ""), TERM_EDGES)


def node_name(text: F.Column, label: F.Column, normal_form=nfkc) -> F.Column:
    """The name of a node in the quality stage: compatibility form, no controls or white space, edges stripped, and the
    lead-ins of its label removed (of symptoms, all of them)."""

    def tidy(t: F.Column) -> F.Column:
        return strip(F.regexp_replace(F.regexp_replace(t, r"[\u0000-\u001f\u007f]", ""), r"[\s 　 -   ]+", ""), NAME_EDGES)

    def by_label(name: F.Column) -> F.Column:
        symptom = F.regexp_replace(name, SYMPTOM_LEADS, "")
        symptom = F.regexp_replace(F.regexp_replace(symptom, "(?:等症状)$", ""), "(?:症状)$", "")
        drug = F.regexp_replace(name, DRUG_LEADS, "")
        exam = F.regexp_replace(F.regexp_replace(name, "等检查$", ""), "等检测$", "")
        return tidy(F.when(label == "Symptom", symptom).when(label == "Drug", drug).when(label == "Examination", exam).otherwise(name))

    name = F.coalesce(text, F.lit(""))
    return let(tidy(normal_form(name) if normal_form is not None else name), by_label)


# Lead-ins and endings of terms and lists, in order.
TERM_EDGES = " ：:，,。；;、"
TERM_LEADS = "^(?:如|例如|比如|包括|主要包括|常见|主要|可|会|需|应|的|发生)"
TERM_ENDS = "(?:等|等等|为主|之一|相关)$"
LIST_LEADS = "^(?:包括|主要包括|有|为|如|例如|可见|可有|可出现|会出现|表现为|主要表现为|症状为|特征为)[:：]?"
LIST_CUT = "[、，,；;/|]|以及|或者|或|和|与"
# Lead-ins of names, in order.
SYMPTOM_LEADS = "^(?:是以|常常伴发|并伴有|伴有|伴随|伴|可出现|出现|表现为|主要表现为|严重时可出现|严重的|严重|明显|轻度|中度|重度|中重度|持续性|阵发性|反复|发作性的|发作的|亦可|为|即|呈|但)+"
DRUG_LEADS = "^(?:即|予|服用|使用|应用|给予|注射|吸入|口服|静脉|外用)"


def split_terms(text: F.Column, limit: int = 24, name=term_name) -> F.Column:
    """Distinct list items before the first end mark: lead-in and numbering dropped, candidates only, in order."""
    head = F.element_at(F.split(name(text), f"[{SENTENCE_END}]", 2), 1)
    head = F.regexp_replace(head, LIST_LEADS, "")
    items = F.transform(F.split(head, LIST_CUT, -1), lambda p: F.regexp_replace(F.regexp_replace(name(p), r"^[0-9]+[.、]", ""), r"^[一二三四五六七八九十]+[、.]", ""))
    return F.array_distinct(F.filter(items, lambda p: is_candidate(name(p), limit)))


def after_marker(text: F.Column, markers: list[str]) -> F.Column:
    """What follows the marker that comes first in the text; of markers at one place the first listed. Null if there is none."""
    hits = F.array(*[F.struct(F.instr(text, m).alias("at"), F.lit(i).alias("rank"), F.lit(len(m)).alias("n")) for i, m in enumerate(markers)])
    first = F.array_min(F.filter(hits, lambda h: h["at"] > 0))
    return let(first, lambda f: F.when(f.isNotNull(), F.substr(text, f["at"] + f["n"])))


def is_candidate(name: F.Column, limit: int = 24) -> F.Column:
    return let(name, lambda n: (F.length(n) >= 2) & (F.length(n) <= limit) & n.rlike("[\\u4e00-\\u9fffA-Za-z0-9]") & ~n.rlike("[，,。；;]"))


def full_text(summary: F.Column | None, sections: F.Column) -> F.Column:
    """Summary, then each section as heading and content, with a blank line between; empty parts left out."""
    parts = F.transform(sections, lambda s: F.trim(F.concat(F.coalesce(s["heading"], F.lit("")), F.lit("\n"), F.coalesce(s["content"], F.lit("")))))
    head = F.array(F.coalesce(summary, F.lit(""))) if summary is not None else F.array().cast("array<string>")
    return F.array_join(F.filter(F.concat(head, parts), lambda p: p != ""), "\n\n")


def stable_id(label: F.Column, name: F.Column) -> F.Column:
    return F.concat(label, F.lit(":"), F.sha1(F.concat(label, F.lit(":"), name).cast("binary")))


def confidence(base: F.Column, score: F.Column) -> F.Column:
    """Three parts base, one part score, within 0 and 0.99, to two places (SQL rounding)."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), 0.75 * base + 0.25 * score)), 2)


def cosine_score(a: F.Column, b: F.Column) -> F.Column:
    """Cosine similarity moved to 0..1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    product = norm(a) * norm(b)
    return F.when(product > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot / product + 1) / 2))).otherwise(0.0)


def parse_confidence(value: F.Column) -> F.Column:
    """A plain decimal number, else null; the cast alone would also take suffixes and words."""
    plain = F.trim(value)
    return F.when(plain.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), plain.try_cast("double"))


def split_ids(value: F.Column, pattern: str = r"[;,\s]+") -> F.Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(value, pattern, -1), lambda x: F.trim(x)), lambda x: x != "")))


def label_of(node_id: F.Column) -> F.Column:
    return F.when(F.contains(node_id, F.lit(":")), F.substring_index(node_id, ":", 1)).otherwise("")
