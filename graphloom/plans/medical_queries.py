"""The rules of the medical graph on names made from its vocabularies, with the ladders written again in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import lexicon as lx
from graphloom.functions import text as tx
from graphloom.operators import extract as ex
from graphloom.operators import quality as qa
from graphloom.plans.registry import query
from graphloom.plans.trade import load
from graphloom.schema import MEDICAL

#: Names are a first word, a second and an ending, chosen by key; every list of the rules is among them.
FIRST = [
    *lx.STRICT_SYMPTOMS, *lx.STRICT_DISEASES, *lx.STRICT_DRUGS, *lx.STRICT_EXAMS, *lx.STRICT_TREATMENTS, *lx.STRICT_GENERIC, *lx.STRICT_FRAGMENTS, *lx.STRICT_DRUG_FRAGMENTS, *lx.STRICT_EXAM_FRAGMENTS,
    *lx.STRICT_DISEASE_ENDINGS, *qa.SYMPTOM_PHRASES, *qa.SYMPTOM_FOREIGN, "无", "不", "为", "口服", "伴有 ", "反复明显", "（", "ABC-1", "12", "x", "", "3年", "术", "的",
]
SECOND = ["", "", "", "", "", *lx.STRICT_DRUG_MARKERS, *lx.STRICT_EXAM_MARKERS, *lx.STRICT_TREATMENT_MARKERS, *lx.STRICT_SYMPTOM_ENDINGS, "药", "素", "与", "的药", "，或", "（一", "）", "，的复合长名称测定与检查之一", *lx.STRICT_GENERIC_BY_LABEL["Treatment"]]
LAST = ["", "", "", "等症状", "症状", "等检查", "等检测", " ", "。", "病"]


def words_sql(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def holds_sql(words) -> str:
    return f"len(list_filter({words_sql(words)}, lambda w: contains(c, w))) > 0"


def ends_sql(words) -> str:
    return f"len(list_filter({words_sql(words)}, lambda w: ends_with(c, w))) > 0"


def among_sql(words) -> str:
    return f"list_contains({words_sql(words)}, c)"


def pick_sql(words, key: str) -> str:
    return f"{words_sql(words)}[1 + ({key}) % {len(words)}]"


EDGES = tx.NAME_EDGES.replace("\t", "").replace("\r", "").replace("\n", "").replace("'", "''")


def tidy_sql(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({text}, '[\x00-\x1f\x7f]', '', 'g'), '\s+', '', 'g'), '{EDGES}')"


NAME_SQL = f"""CASE label WHEN 'Symptom' THEN regexp_replace(regexp_replace(regexp_replace(a, '{tx.SYMPTOM_LEADS}', ''), '(等症状)$', ''), '(症状)$', '')
 WHEN 'Drug' THEN regexp_replace(a, '{tx.DRUG_LEADS}', '') WHEN 'Examination' THEN regexp_replace(regexp_replace(a, '等检查$', ''), '等检测$', '') ELSE a END"""
GENERIC_SQL = " ".join(f"WHEN '{label}' THEN {among_sql(words)}" for label, words in lx.STRICT_GENERIC_BY_LABEL.items())
OWN_SQL = " ".join(f"WHEN '{label}' THEN list_filter({words_sql(words)}, lambda w: contains(c, w))[1]" for label, words in (("Drug", lx.STRICT_DRUG_FRAGMENTS), ("Examination", lx.STRICT_EXAM_FRAGMENTS), ("Treatment", lx.STRICT_TREATMENT_FRAGMENTS)))
RULES_SQL = {
    "Disease": f"WHEN length(c) > 24 THEN 'disease_name_too_long' WHEN {holds_sql(qa.DISEASE_FOREIGN)} THEN 'disease_contains_non_disease_word' WHEN {among_sql([*lx.STRICT_DISEASES, '休克', '感染', '贫血'])} THEN NULL WHEN NOT ({holds_sql(lx.STRICT_DISEASE_ENDINGS)}) THEN 'not_disease_like'",
    "Symptom": f"""WHEN length(c) > 14 THEN 'symptom_name_too_long' WHEN starts_with(c, '无') THEN 'negated_symptom' WHEN {among_sql(lx.STRICT_DISEASES)} THEN 'symptom_is_disease' WHEN {holds_sql(qa.SYMPTOM_PHRASES)} THEN 'symptom_phrase_fragment'
 WHEN {holds_sql(qa.SYMPTOM_FOREIGN)} THEN 'symptom_contains_wrong_domain_word' WHEN NOT ({holds_sql(lx.STRICT_SYMPTOMS)} OR {ends_sql(lx.STRICT_SYMPTOM_ENDINGS)}) THEN 'not_symptom_like'""",
    "Drug": f"""WHEN length(c) > 20 THEN 'drug_name_too_long' WHEN {among_sql(lx.STRICT_DRUGS)} THEN NULL WHEN regexp_matches(c, '{qa.DRUG_OPENINGS}') THEN 'drug_phrase_prefix' WHEN regexp_full_match(c, '[A-Za-z0-9βα+/-]+') THEN 'drug_abbreviation_without_class'
 WHEN {holds_sql(qa.DRUG_JOINTS)} THEN 'compound_or_sentence_fragment' WHEN contains(c, '的') THEN 'drug_phrase_with_de' WHEN NOT ({holds_sql(lx.STRICT_DRUG_MARKERS)} OR length(c) <= 8 AND (ends_with(c, '药') OR ends_with(c, '素'))) THEN 'not_drug_like'""",
    "Examination": f"""WHEN length(c) > 24 THEN 'exam_name_too_long' WHEN {among_sql(lx.STRICT_EXAMS)} THEN NULL WHEN regexp_matches(c, '{qa.EXAM_OPENINGS}') THEN 'exam_phrase_prefix' WHEN contains(c, '的') THEN 'exam_phrase_with_de'
 WHEN regexp_matches(c, '[0-9]+\\s*年') THEN 'time_expression' WHEN {holds_sql(qa.EXAM_JOINTS)} THEN 'compound_exam' WHEN NOT ({holds_sql(lx.STRICT_EXAM_MARKERS)}) THEN 'not_exam_like'""",
    "Treatment": f"WHEN length(c) > 18 THEN 'treatment_name_too_long' WHEN {among_sql(lx.STRICT_TREATMENTS)} THEN NULL WHEN NOT ({holds_sql(lx.STRICT_TREATMENT_MARKERS)}) THEN 'not_treatment_like'",
}
# of the compatibility forms, those that the names hold
LADDERS_SQL = " ".join(f"WHEN '{label}' THEN CASE {steps} END" for label, steps in RULES_SQL.items())
MEDICAL_SQL = f"""WITH raw AS (SELECT k, [{", ".join(repr(x) for x in MEDICAL.labels)}, 'Other'][1 + k % 6] AS label, {pick_sql(FIRST, 'k // 6')} || {pick_sql(SECOND, 'k * 7 // 5')} || {pick_sql(LAST, 'k // 11')} AS name FROM (SELECT unnest(range(20 * n)) AS k FROM (SELECT count(*) AS n FROM supplier))),
x AS (SELECT *, {tidy_sql("translate(name, '（）：，；！？', '():,;!?')")} AS a FROM raw), y AS (SELECT k, label, {tidy_sql(NAME_SQL)} AS c FROM x),
z AS (SELECT *, CASE WHEN c <> '' THEN coalesce(list_filter({words_sql(lx.STRICT_FRAGMENTS)}, lambda w: contains(c, w))[1], CASE label {OWN_SQL} END) END AS fragment FROM y),
m AS (SELECT k, label, c AS clean_name, CASE WHEN label = 'Other' THEN 'invalid_node_label' WHEN c = '' THEN 'empty_name' WHEN NOT regexp_matches(c, '[一-鿿A-Za-z]') THEN 'no_meaningful_text' WHEN regexp_matches(c, '[，。；！？]') THEN 'sentence_like_punctuation'
 WHEN regexp_matches(c, '[(（][^()（）]*$') THEN 'unbalanced_bracket' WHEN {among_sql(lx.STRICT_GENERIC)} OR coalesce(CASE label {GENERIC_SQL} END, FALSE) THEN 'generic_term' WHEN fragment IS NOT NULL THEN 'bad_fragment:' || fragment WHEN length(c) < 2 THEN 'too_short'
 ELSE CASE label {LADDERS_SQL} END END AS reason FROM z)"""


def names(spark, d):
    """Twenty names per supplier."""
    k = F.col("k")
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (F.floor(n) % len(words) + 1).cast("int"))
    label = F.element_at(F.array(*[F.lit(x) for x in (*MEDICAL.labels, "Other")]), (k % 6 + 1).cast("int"))
    # a range is dealt over the cores, an exploded row would be one task's
    keys = spark.range(20 * load(spark, d, "supplier").count()).select(F.col("id").alias("k"))
    return keys.select(k.alias("seq"), k.cast("string").alias("node_id"), label.alias("label"), F.concat(pick(FIRST, k / 6), pick(SECOND, k * 7 / 5), pick(LAST, k / 11)).alias("name"), k.cast("string").alias("source_doc_ids"), F.lit("").alias("description"))


@query(f"{MEDICAL_SQL} SELECT k, label, clean_name, reason FROM m")
def qa_medical_reasons(spark, d):
    return qa.judge_nodes(names(spark, d)).select(F.col("seq").alias("k"), "label", "clean_name", "reason")


@query(f"{MEDICAL_SQL} SELECT label || ':' || sha1(label || ':' || clean_name) AS node_id, clean_name AS name, label, count(*) AS n_docs FROM m WHERE reason IS NULL GROUP BY label, clean_name")
def qa_medical_nodes(spark, d):
    return qa.clean_nodes(qa.judge_nodes(names(spark, d))).select("node_id", "name", "label", F.size("docs").cast("long").alias("n_docs"))


@query(rf"SELECT s_suppkey AS k, trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(name, '^[（(【\[]+', ''), '[）)】\]]+$', ''), '{tx.TERM_EDGES}'), '{tx.TERM_LEADS}', ''), '{tx.TERM_ENDS}', ''), '{tx.TERM_EDGES}') AS term FROM (SELECT s_suppkey, {pick_sql(['（如', '例如', '主要包括：', '[', '可', '', '发生'], 's_suppkey')} || {pick_sql(lx.RECALL_SYMPTOMS, 's_suppkey')} || {pick_sql(['等', '等等）', '之一', '，', '', '为主】'], 's_suppkey')} AS name FROM supplier)")
def ext_term_names(spark, d):
    k = F.col("s_suppkey")
    pick = lambda words: F.element_at(F.array(*[F.lit(w) for w in words]), (k % len(words) + 1).cast("int"))
    name = F.concat(pick(["（如", "例如", "主要包括：", "[", "可", "", "发生"]), pick(lx.RECALL_SYMPTOMS), pick(["等", "等等）", "之一", "，", "", "为主】"]))
    return load(spark, d, "supplier").select(k.alias("k"), tx.term_name(name).alias("term"))


@query(f"SELECT s_suppkey AS k, {pick_sql(lx.RECALL_DISEASES, 's_suppkey')} AS term FROM supplier")
def ext_refined(spark, d):
    k = F.col("s_suppkey")
    pick = lambda words: F.element_at(F.array(*[F.lit(w) for w in words]), (k % len(words) + 1).cast("int"))
    return load(spark, d, "supplier").select(k.alias("k"), ex.refine_disease(F.concat(pick(["长期导致", "可引起", "出现", ""]), pick(lx.RECALL_DISEASES), pick(["：说明", ""]))).alias("term"))
