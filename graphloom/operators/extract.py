"""Rule-based extraction of entities and relations from cleaned documents.

documents → sections → sentences → candidates per label → scored triples → nodes and edges. Every step is
a column expression; only the embedding of a scorer may need Python. Vocabularies are arguments.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import lexicon as lx
from graphloom.functions import text as tx

#: Gives rows (label, term, evidence, ...) a column ``score`` in 0..1.
Scorer = Callable[[DataFrame], DataFrame]
BASES = {"Symptom": 0.86, "Drug": 0.86, "Examination": 0.86, "Treatment": 0.84, "Heading": 0.90, "Disease": 0.82}
#: Route and confidence of the symptoms that an infobox lists.
INFOBOX, INFOBOX_SYMPTOM = -1, 0.92
LIMITS = {"Symptom": 14, "Drug": 24, "Examination": 24, "Treatment": 18, "Disease": 14}
# Patterns and cues.
CJK = "\\u4e00-\\u9fff"
DRUG_PATTERN = f"[{CJK}A-Za-z0-9β-]{{2,24}}(?:药|药物|素|片|胶囊|剂|针|酯|胺|霉素|沙星|他汀|普利|沙坦|洛尔|地平|拉唑)"
EXAM_PATTERN = f"[{CJK}A-Za-z0-9-]{{1,24}}(?:检查|检测|检验|测定|试验|造影|心电图|CT|MRI|超声|胃镜|肠镜|血常规|尿常规)"
DISEASE_PATTERN = f"[{CJK}A-Za-z0-9β-]{{2,10}}(?:{'|'.join(lx.RECALL_DISEASE_ENDINGS)})"
COMPLICATION_CUES = "并发 并发症 合并症 合并".split()
COMPLICATION_BLOCK = "症状 诊断 检查 体检 治疗 生活质量".split()
DISEASE_TRIGGERS = "导致 引发 引起 造成 诱发 出现 并发 包括 发生".split()
TREATMENT_CUES = (("手术",), "手术治疗"), (("化疗",), "化疗"), (("放疗",), "放疗"), (("康复",), "康复治疗"), (("饮食", "营养"), "饮食控制"), (("运动",), "运动治疗")
SYMPTOM_CUES = "症状 表现 出现 伴有 可见".split()
EXAM_CUES = "检查 检验 检测 诊断 造影 心电图 CT MRI 超声".split()
TREATMENT_SENTENCE_CUES = "治疗 手术 康复 饮食 运动 介入 透析 氧疗".split()


def has_any(text: Column, words) -> Column:
    """Whether the text holds one of the words, as one alternation rather than a test per word."""
    quoted = "|".join("\\Q" + w + "\\E" for w in words)
    return text.rlike(quoted) if words else F.lit(False)


def ends_with_any(text: Column, words) -> Column:
    return text.rlike("(?:" + "|".join("\\Q" + w + "\\E" for w in words) + ")$")


def sentences(documents: DataFrame, ends: str = tx.SENTENCE_END) -> DataFrame:
    """(doc_id, sec_pos, heading, sent_pos, sentence) of documents(doc_id, sections)."""
    sections = documents.select("doc_id", F.posexplode("sections").alias("sec_pos", "section"))
    named = sections.select("doc_id", "sec_pos", tx.clean_text(F.col("section.heading")).alias("heading"), tx.clean_text(F.col("section.content")).alias("content"))
    return named.select("doc_id", "sec_pos", "heading", F.posexplode(tx.sentences(F.col("content"), ends)).alias("sent_pos", "sentence"))


def known_terms(text: Column, terms: list[str]) -> Column:
    """Terms of the vocabulary in the text, longest first."""
    ordered = sorted(dict.fromkeys(terms), key=lambda t: -len(t))
    return F.filter(F.array(*[F.lit(t) for t in ordered]), lambda t: F.contains(text, t))


def pattern_terms(text: Column, pattern: str, limit: int) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), tx.term_name)
    return F.array_distinct(F.filter(found, lambda t: tx.is_candidate(tx.term_name(t), limit)))


def balanced(text: Column) -> Column:
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return (count("（") == count("）")) & (count("(") == count(")"))


#: Words that a tagger knows as names, from the vocabularies.
DICTIONARY = [*lx.RECALL_DRUGS, *lx.RECALL_EXAMS, *lx.RECALL_TREATMENTS, *lx.RECALL_SYMPTOMS, *lx.RECALL_DISEASES]
TAGGED = "array<struct<word:string,flag:string>>"


def tagged(text: Column, dictionary: list[str] = DICTIONARY) -> Column:
    """Words with flags, from left to right: the longest name of the dictionary (n), a run of letters and digits (eng), or
    one other character (x); white space is left out. The part of speech of other words needs a model that isn't installed.
    """
    names = sorted(dict.fromkeys(dictionary), key=lambda t: (-len(t), t))
    known = "|".join("\\Q" + t + "\\E" for t in names)
    words = F.regexp_extract_all(text, F.lit(f"{known}|[A-Za-z0-9]+|\\S"), F.lit(0))
    flag = lambda w: F.when(w.isin(*names), "n").when(w.rlike("^[A-Za-z0-9]"), "eng").otherwise("x")
    return F.transform(words, lambda w: F.struct(w.alias("word"), flag(w).alias("flag"))).cast(TAGGED)


def lexical_candidates(text: Column, limit: int, dictionary: list[str] = DICTIONARY) -> Column:
    """Distinct nouns and verbs of the tagged text that can be terms, in order."""
    words = F.filter(tagged(text, dictionary), lambda t: t["flag"].rlike("^[nv]"))
    terms = F.transform(words, lambda t: tx.term_name(t["word"]))
    return F.array_distinct(F.filter(terms, lambda t: tx.is_candidate(tx.term_name(t), limit)))


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """A vector of counts of letter pairs, by the sum of their code points: needs no model and no Python."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.pmod(F.ascii(F.substr(text, i, F.lit(1))) * 31 + F.ascii(F.substr(text, i + 1, F.lit(1))), F.lit(size)))
    return tx.let(pairs, lambda p: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda b: F.size(F.filter(p, lambda x: x == b)).cast("double")))


def symptom_terms(s: Column) -> Column:
    listed = F.coalesce(tx.split_terms(tx.after_marker(s, lx.RECALL_LIST_MARKERS), 14), F.array().cast("array<string>"))
    return F.concat(known_terms(s, lx.RECALL_SYMPTOMS), listed, F.filter(lexical_candidates(s, 12), symptom_like))


def symptom_like(t: Column) -> Column:
    return t.isin(*lx.RECALL_SYMPTOMS) | ends_with_any(t, lx.RECALL_SYMPTOM_ENDINGS)


def treatment_terms(s: Column) -> Column:
    implied = F.array_compact(F.array(*[F.when(has_any(s, cues), F.lit(term)) for cues, term in TREATMENT_CUES]))
    return F.concat(known_terms(s, lx.RECALL_TREATMENTS), implied)


def after(word: str):
    return lambda v: F.when(F.contains(v, F.lit(word)), F.substr(v, F.instr(v, word) + len(word))).otherwise(v)


def refine_disease(t: Column) -> Column:
    value = F.element_at(F.split(tx.term_name(t), "[:：]", 2), 1)
    for trigger in DISEASE_TRIGGERS:
        value = tx.let(value, after(trigger))
    return tx.term_name(value)


@dataclass(frozen=True)
class Route:
    """When a sentence is searched for a label, as which relation, and the greatest confidence."""

    label: str
    relation: str
    when: Callable[[Column, Column], Column]
    cap: float = 1.0
    reverse: bool = False


def in_heading(words):
    return lambda heading, sentence: has_any(heading, words)


def in_sentence(words):
    return lambda heading, sentence: has_any(sentence, words)


ROUTES = (
    Route("Symptom", "HAS_SYMPTOM", in_heading(lx.RECALL_SYMPTOM_HEADINGS)),
    Route("Examination", "REQUIRES_EXAM", in_heading(lx.RECALL_EXAM_HEADINGS)),
    Route("Drug", "TREATS_DISEASE", in_heading([*lx.RECALL_DRUG_HEADINGS, *lx.RECALL_TREATMENT_HEADINGS]), reverse=True),
    Route("Treatment", "TREATED_BY", in_heading(lx.RECALL_TREATMENT_HEADINGS)),
    Route("Disease", "HAS_COMPLICATION", in_heading(lx.RECALL_COMPLICATION_HEADINGS)),
    Route("Symptom", "HAS_SYMPTOM", in_sentence(SYMPTOM_CUES), 0.82),
    Route("Examination", "REQUIRES_EXAM", in_sentence(EXAM_CUES), 0.82),
    Route("Drug", "TREATS_DISEASE", in_sentence(TREATMENT_SENTENCE_CUES), 0.82, reverse=True),
    Route("Treatment", "TREATED_BY", in_sentence(TREATMENT_SENTENCE_CUES), 0.80),
)


def candidates(lines: DataFrame) -> DataFrame:
    """(doc_id, sec_pos, heading, sent_pos, sentence, label, cand_pos, term) for every label at once, shape tested."""
    s = F.col("sentence")
    terms = {
        "Symptom": symptom_terms(s),
        "Drug": F.concat(known_terms(s, lx.RECALL_DRUGS), pattern_terms(s, DRUG_PATTERN, 24)),
        "Examination": F.concat(known_terms(s, lx.RECALL_EXAMS), pattern_terms(s, EXAM_PATTERN, 24)),
        "Treatment": treatment_terms(s),
        "Disease": F.when(has_any(s, COMPLICATION_CUES), F.transform(pattern_terms(s, DISEASE_PATTERN, 14), refine_disease)).otherwise(F.array().cast("array<string>")),
    }
    every = F.array(*[F.struct(F.lit(label).alias("label"), t.alias("terms")) for label, t in terms.items()])
    rows = lines.select("*", F.explode(every).alias("x")).select(*lines.columns, "x.label", F.posexplode("x.terms").alias("cand_pos", "raw"))
    rows = rows.withColumn("term", tx.term_name(F.col("raw"))).drop("raw")
    limit = F.lit(24)
    for label, n in LIMITS.items():
        limit = F.when(F.col("label") == label, n).otherwise(limit)
    t = F.col("term")
    fine = tx.is_candidate(tx.term_name(t), 99) & (F.length(t) <= limit)
    own = (
        F.when(F.col("label") == "Symptom", symptom_like(t))
        .when(F.col("label") == "Treatment", balanced(t) & ~has_any(t, ["？", "?"]))
        .when(F.col("label") == "Disease", ~has_any(t, COMPLICATION_BLOCK) & has_any(t, lx.RECALL_DISEASE_ENDINGS))
        .otherwise(F.lit(True))
    )
    return rows.filter(fine & own)


def vocabulary(documents: DataFrame, known: list[str] = lx.RECALL_DISEASES) -> DataFrame:
    """Distinct disease names: the known ones, titles, keywords, and headings that look like a disease."""
    base = documents.sparkSession.createDataFrame([(t,) for t in known], "term string")
    headings = documents.select(F.explode("sections.heading").alias("term")).select(tx.term_name(F.col("term")).alias("term"))
    headings = headings.filter(has_any(F.col("term"), lx.RECALL_DISEASE_ENDINGS) & tx.is_candidate(F.col("term"), 14))
    named = documents.select(F.explode(F.array("title", "keyword")).alias("term")).select(tx.term_name(F.col("term")))
    return base.union(named.union(headings)).filter(tx.is_candidate(F.col("term"))).distinct()


def infobox(documents: DataFrame) -> DataFrame:
    """(doc_id, sec_pos, heading, value) of the entries of basic_info; sec_pos counts down from -1, apart from the sections."""
    entries = documents.select("doc_id", F.posexplode("basic_info").alias("pos", "key", "value"))
    return entries.select("doc_id", (-1 - F.col("pos")).alias("sec_pos"), tx.term_name(F.col("key")).alias("heading"), tx.clean_text(F.col("value")).alias("value")).filter("value != ''")


def infobox_symptoms(box: DataFrame) -> DataFrame:
    """Routed candidates of the entries on symptoms: the items of their lists."""
    items = box.filter(F.contains("heading", F.lit("症状"))).select("*", F.posexplode(tx.split_terms(F.col("value"), 14)).alias("cand_pos", "term"))
    fixed = [F.lit(INFOBOX).alias("route"), F.lit("HAS_SYMPTOM").alias("relation"), F.lit(1.0).alias("cap"), F.lit(False).alias("reverse")]
    return items.filter(symptom_like(F.col("term"))).select("doc_id", "sec_pos", "heading", F.lit(0).alias("sent_pos"), F.col("value").alias("sentence"), F.lit("Symptom").alias("label"), "cand_pos", "term", *fixed)


def first_occurrences(found: DataFrame, key: list[str]) -> DataFrame:
    """The first row of each key by sentence, then candidate; min over a struct combines before the shuffle."""
    rest = [c for c in found.columns if c not in key and c not in ("sent_pos", "cand_pos")]
    first = found.groupBy(*key).agg(F.min(F.struct("sent_pos", "cand_pos", *rest)).alias("r"))
    return first.select(*key, "r.*")


def constant_scorer(value: float = 0.5) -> Scorer:
    return lambda rows: rows.withColumn("score", F.lit(value))


def embedding_scorer(embed: Callable[[Column], Column], anchors: dict[str, list[float]]) -> Scorer:
    """Cosine of the embedded "term evidence" to its label's anchor; each distinct (label, term, evidence) is embedded once."""

    def score(rows: DataFrame) -> DataFrame:
        key = F.substring("evidence", 1, 120)
        distinct = rows.select("label", "term", key.alias("head")).distinct()
        anchor = F.create_map(*[x for k, v in anchors.items() for x in (F.lit(k), F.array(*[F.lit(float(y)) for y in v]))])
        vectors = distinct.withColumn("vector", embed(F.concat_ws(" ", "term", "head")))
        scored = vectors.withColumn("score", tx.cosine_score(F.col("vector"), anchor[F.col("label")])).drop("vector")
        return rows.withColumn("head", key).join(scored, ["label", "term", "head"], "left").drop("head")

    return score


def extract(documents: DataFrame, scorer: Scorer | None = None, routes: tuple[Route, ...] = ROUTES, ends: str = tx.SENTENCE_END) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) before merging. documents(doc_id, title, keyword, summary, sections), and basic_info where there is one."""
    score = scorer or constant_scorer()
    found = candidates(sentences(documents, ends))
    vocab = vocabulary(documents)
    # only complications are bound to the vocabulary
    diseases = found.filter("label = 'Disease'").join(vocab, "term", "left_semi").select(*found.columns)
    found = found.filter("label != 'Disease'").unionByName(diseases)
    ways = F.array(
        *[
            F.when((F.col("label") == r.label) & r.when(F.col("heading"), F.col("sentence")), F.struct(F.lit(i).alias("route"), F.lit(r.relation).alias("relation"), F.lit(r.cap).alias("cap"), F.lit(r.reverse).alias("reverse")))
            for i, r in enumerate(routes)
        ]
    )
    routed = found.withColumn("way", F.explode(F.array_compact(ways))).select(*found.columns, "way.*")
    heading = tx.term_name(F.col("heading"))
    headed = sentences(documents, ends).select("doc_id", "sec_pos", "heading").distinct()
    if "basic_info" in documents.columns:
        box = infobox(documents)
        cures = box.filter(F.contains("heading", F.lit("治疗")) & ~F.contains("heading", F.lit("症状")))
        lines = cures.select("doc_id", "sec_pos", "heading", F.posexplode(tx.sentences(F.col("value"), ends)).alias("sent_pos", "sentence"))
        fixed = [F.lit(3).alias("route"), F.lit("TREATED_BY").alias("relation"), F.lit(1.0).alias("cap"), F.lit(False).alias("reverse")]
        named = candidates(lines).filter("label = 'Treatment'").select(*found.columns, *fixed)
        routed = routed.unionByName(infobox_symptoms(box)).unionByName(named)
        headed = headed.unionByName(cures.select("doc_id", "sec_pos", "heading"))
    headed = headed.withColumn("term", heading)
    headed = headed.filter(F.contains("term", F.lit("治疗")) & tx.is_candidate(F.col("term"), 18) & balanced(F.col("term")))
    treated = headed.select("doc_id", "sec_pos", "heading", F.lit(-1).alias("sent_pos"), F.col("term").alias("sentence"), F.lit("Treatment").alias("label"), F.lit(-1).alias("cand_pos"), "term", F.lit(3).alias("route"), F.lit("TREATED_BY").alias("relation"), F.lit(1.0).alias("cap"), F.lit(False).alias("reverse"))
    treated = treated.filter(has_any(F.col("heading"), lx.RECALL_TREATMENT_HEADINGS))
    once = first_occurrences(routed.unionByName(treated), ["doc_id", "sec_pos", "route", "label", "term"])
    evidence = once.withColumn("evidence", tx.short_evidence(F.col("sentence")))
    base = F.lit(0.0)
    for label, b in BASES.items():
        base = F.when(F.col("label") == label, b).otherwise(base)
    base = F.when((F.col("label") == "Treatment") & (F.col("sentence") == F.col("term")) & has_any(F.col("heading"), lx.RECALL_TREATMENT_HEADINGS) & (F.col("term") == tx.term_name(F.col("heading"))), BASES["Heading"]).otherwise(base)
    rated = score(evidence).withColumn("confidence", F.when(F.col("route") == INFOBOX, INFOBOX_SYMPTOM).otherwise(F.least(tx.confidence(base, F.col("score")), F.col("cap"))))
    names = documents.select("doc_id", tx.term_name(F.coalesce(F.nullif("title", F.lit("")), "keyword")).alias("disease"), F.coalesce("summary", F.lit("")).alias("summary"))
    facts = rated.join(names.filter("disease != ''"), "doc_id").filter(F.col("term") != F.col("disease"))
    own, other = tx.stable_id(F.lit("Disease"), F.col("disease")), tx.stable_id(F.col("label"), F.col("term"))
    edges = facts.select(F.when(F.col("reverse"), other).otherwise(own).alias("src"), F.when(F.col("reverse"), own).otherwise(other).alias("dst"), F.col("relation").alias("rel_type"), F.col("doc_id").alias("source_doc_id"), "evidence", "confidence", F.col("heading").alias("section"))
    described = names.filter("disease != ''").select(own.alias("node_id"), F.col("disease").alias("name"), F.lit("Disease").alias("label"), F.array("doc_id").alias("docs"), F.col("summary").alias("description"), F.col("doc_id").alias("seq"))
    terms = facts.select(other.alias("node_id"), F.col("term").alias("name"), "label", F.array("doc_id").alias("docs"), F.lit("").alias("description"), F.col("doc_id").alias("seq"))
    return described.unionByName(terms), edges
