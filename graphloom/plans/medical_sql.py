"""The extraction of the medical documents once more, as one SQL statement: the twin of ``extract``.

Terms are sets per sentence; a term's first sentence in a section is its evidence, and of an edge's rows the one with the
greatest confidence stays, ties going to the least evidence and section.
"""

from __future__ import annotations

from graphloom import lexicon as lx
from graphloom.functions import text as tx
from graphloom.operators import extract as ex


def words(items) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in items) + "]"


def pick(items, key: str) -> str:
    return f"{words(items)}[1 + CAST({key} AS BIGINT) % {len(items)}]"


def has(text: str, items) -> str:
    return f"len(list_filter({words(items)}, lambda w: contains({text}, w))) > 0"


def name(text: str) -> str:
    """The name of a term; the documents hold nothing that cleaning would change."""
    bare = rf"trim(regexp_replace(regexp_replace({text}, '^[（(【\[]+', ''), '[）)】\]]+$', ''), '{tx.TERM_EDGES}')"
    return f"trim(regexp_replace(regexp_replace({bare}, '{tx.TERM_LEADS}', ''), '{tx.TERM_ENDS}', ''), '{tx.TERM_EDGES}')"


def fits(text: str, limit: int) -> str:
    n = name(text)
    return f"(length({n}) BETWEEN 2 AND {limit} AND regexp_matches({n}, '[一-鿿A-Za-z0-9]') AND NOT regexp_matches({n}, '[，,。；;]'))"


def known(text: str, items) -> str:
    return f"list_filter({words(items)}, lambda w: contains({text}, w))"


def listed(text: str, limit: int) -> str:
    head = f"regexp_replace(regexp_split_to_array({name(text)}, '[{tx.SENTENCE_END}]')[1], '{tx.LIST_LEADS}', '')"
    items = f"list_transform(regexp_split_to_array({head}, '{tx.LIST_CUT}'), lambda p: regexp_replace(regexp_replace({name('p')}, '^[0-9]+[.、]', ''), '^[一二三四五六七八九十]+[、.]', ''))"
    return f"list_filter({items}, lambda p: {fits('p', limit)})"


def matched(text: str, pattern: str, limit: int) -> str:
    plain = pattern.replace("\\u4e00-\\u9fff", "一-鿿")
    return f"list_filter(list_transform(regexp_extract_all({text}, '{plain}'), lambda p: {name('p')}), lambda p: {fits('p', limit)})"


def symptom(t: str) -> str:
    return f"(list_contains({words(lx.RECALL_SYMPTOMS)}, {t}) OR len(list_filter({words(lx.RECALL_SYMPTOM_ENDINGS)}, lambda e: ends_with({t}, e))) > 0)"


DICTIONARY = sorted(dict.fromkeys(ex.DICTIONARY), key=lambda t: (-len(t), t))
PLACES = f"list_min(list_filter(list_transform(range({len(lx.RECALL_LIST_MARKERS)}), lambda i: (instr(s, {words(lx.RECALL_LIST_MARKERS)}[i + 1]), i, length({words(lx.RECALL_LIST_MARKERS)}[i + 1]))), lambda p: p[1] > 0))"
LEXICAL = f"list_filter(regexp_extract_all(s, '{'|'.join(DICTIONARY)}|[A-Za-z0-9]+|[^\\s]'), lambda w: list_contains({words(DICTIONARY)}, w) AND {fits('w', 12)} AND {symptom(name('w'))})"
IMPLIED = " || ".join(f"CASE WHEN {has('s', cues)} THEN ['{term}'] ELSE [] END" for cues, term in ex.TREATMENT_CUES)


def refined(text: str) -> str:
    value = f"regexp_split_to_array({name(text)}, '[:：]')[1]"
    for trigger in ex.DISEASE_TRIGGERS:
        value = f"regexp_replace({value}, '^.*?{trigger}', '')"
    return name(value)


TERMS = {
    "Symptom": (f"list_concat(list_concat({known('s', lx.RECALL_SYMPTOMS)}, coalesce({listed('substr(s, mark[1] + mark[3])', 14)}, [])), {LEXICAL})", f"{fits('t', 14)} AND {symptom('t')}"),
    "Drug": (f"list_concat({known('s', lx.RECALL_DRUGS)}, {matched('s', ex.DRUG_PATTERN, 24)})", fits("t", 24)),
    "Examination": (f"list_concat({known('s', lx.RECALL_EXAMS)}, {matched('s', ex.EXAM_PATTERN, 24)})", fits("t", 24)),
    "Treatment": (f"list_concat({known('s', lx.RECALL_TREATMENTS)}, {IMPLIED})", f"{fits('t', 18)} AND NOT regexp_matches(t, '[?？]') AND length(replace(t, '（', '')) = length(replace(t, '）', '')) AND length(replace(t, '(', '')) = length(replace(t, ')', ''))"),
    "Disease": (
        f"CASE WHEN {has('s', ex.COMPLICATION_CUES)} THEN list_transform({matched('s', ex.DISEASE_PATTERN, 14)}, lambda p: {refined('p')}) ELSE [] END",
        f"{fits('t', 14)} AND NOT ({has('t', ex.COMPLICATION_BLOCK)}) AND {has('t', lx.RECALL_DISEASE_ENDINGS)} AND t IN (SELECT term FROM vocab)",
    ),
}
TERM_ROWS = " UNION ALL ".join(f"SELECT doc_id, sec, heading, pos, s, '{label}' AS label, unnest(list_distinct(list_transform({terms}, lambda p: {name('p')}))) AS t FROM marked" for label, (terms, _) in TERMS.items())
TERM_TEST = " ".join(f"WHEN '{label}' THEN {test}" for label, (_, test) in TERMS.items())
HEADS = {
    0: ("Symptom", "HAS_SYMPTOM", f"sec >= 0 AND {has('heading', lx.RECALL_SYMPTOM_HEADINGS)}", 0.86, 1.0),
    1: ("Examination", "REQUIRES_EXAM", f"sec >= 0 AND {has('heading', lx.RECALL_EXAM_HEADINGS)}", 0.86, 1.0),
    2: ("Drug", "TREATS_DISEASE", f"sec >= 0 AND {has('heading', [*lx.RECALL_DRUG_HEADINGS, *lx.RECALL_TREATMENT_HEADINGS])}", 0.86, 1.0),
    3: ("Treatment", "TREATED_BY", f"(sec < 0 OR {has('heading', lx.RECALL_TREATMENT_HEADINGS)})", 0.84, 1.0),
    4: ("Disease", "HAS_COMPLICATION", f"sec >= 0 AND {has('heading', lx.RECALL_COMPLICATION_HEADINGS)}", 0.82, 1.0),
    5: ("Symptom", "HAS_SYMPTOM", f"sec >= 0 AND {has('s', ex.SYMPTOM_CUES)}", 0.86, 0.82),
    6: ("Examination", "REQUIRES_EXAM", f"sec >= 0 AND {has('s', ex.EXAM_CUES)}", 0.86, 0.82),
    7: ("Drug", "TREATS_DISEASE", f"sec >= 0 AND {has('s', ex.TREATMENT_SENTENCE_CUES)}", 0.86, 0.82),
    8: ("Treatment", "TREATED_BY", f"sec >= 0 AND {has('s', ex.TREATMENT_SENTENCE_CUES)}", 0.84, 0.80),
}


def rated(base: float, cap: float) -> float:
    """Three parts base, one part of the constant score one half; no base has a tie at the third place but 0.86 (0.77) and 0.84 (0.755)."""
    return min(float(f"{0.75 * base + 0.125 + 1e-9:.2f}"), cap)


ROUTED = " UNION ALL ".join(f"SELECT doc_id, sec, heading, pos, s, label, t, {k} AS route, '{kind}' AS kind, {rated(base, cap)} AS c FROM good WHERE label = '{label}' AND {when}" for k, (label, kind, when, base, cap) in HEADS.items())
SECTIONS = [
    ("症状", f"'主要表现为' || {pick(lx.RECALL_SYMPTOMS, 'k * 3')} || '、' || {pick(lx.RECALL_SYMPTOMS, 'k * 13')} || '等。'"),
    ("药物治疗", f"'可用' || {pick(lx.RECALL_DRUGS, 'k * 5')} || '治疗。必要时手术。'"),
    ("检查", f"'需做' || {pick(lx.RECALL_EXAMS, 'k * 7')} || '；以及' || {pick(lx.RECALL_TREATMENTS, 'k * 11')} || '。'"),
    ("并发症", f"'可并发' || {pick(lx.RECALL_DISEASES, 'k * 17')} || '。'"),
]
SECTION_ROWS = " UNION ALL ".join(f"SELECT doc_id, {i} AS sec, '{heading}' AS heading, {content} AS content FROM d" for i, (heading, content) in enumerate(SECTIONS))
CUT = f"[^{tx.SENTENCE_END}]*[{tx.SENTENCE_END}]|[^{tx.SENTENCE_END}]+"

EXTRACT_SQL = f"""WITH d AS (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS doc_id, {pick(lx.RECALL_DISEASES, 's_suppkey')} AS disease FROM supplier),
secs AS ({SECTION_ROWS}),
vocab AS (SELECT unnest({words(lx.RECALL_DISEASES)}) AS term UNION SELECT disease FROM d UNION SELECT {name('heading')} FROM secs WHERE {has(name('heading'), lx.RECALL_DISEASE_ENDINGS)}),
cures AS (SELECT doc_id, -2 AS sec, '治疗方法' AS heading, {pick(lx.RECALL_TREATMENTS, 'k * 29')} || '，化疗' AS content FROM d),
lines AS (SELECT doc_id, sec, heading, unnest(regexp_extract_all(content, '{CUT}')) AS s, generate_subscripts(regexp_extract_all(content, '{CUT}'), 1) AS pos FROM (FROM secs UNION ALL FROM cures)),
marked AS (SELECT *, {PLACES} AS mark FROM lines),
terms AS ({TERM_ROWS}),
good AS (SELECT * FROM terms WHERE CASE label {TERM_TEST} END),
heads AS (SELECT DISTINCT doc_id, sec, heading, {name('heading')} AS t FROM (FROM secs UNION ALL FROM cures) WHERE contains({name('heading')}, '治疗') AND {fits('heading', 18)} AND {has('heading', lx.RECALL_TREATMENT_HEADINGS)}),
box AS (SELECT doc_id, {pick(lx.RECALL_SYMPTOMS, 'k * 19')} || '、' || {pick(lx.RECALL_SYMPTOMS, 'k * 23')} AS value FROM d),
boxed AS (SELECT doc_id, value, unnest(list_distinct({listed('value', 14)})) AS t FROM box),
routed AS ({ROUTED} UNION ALL SELECT doc_id, sec, heading, 0, t, 'Treatment', t, 3, 'TREATED_BY', {rated(0.9, 1.0)} FROM heads
 UNION ALL SELECT doc_id, -1, {name("'常见症状'")}, 0, value, 'Symptom', t, -1, 'HAS_SYMPTOM', 0.92 FROM boxed WHERE {symptom('t')}),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sec, route, label, t ORDER BY pos) AS rn FROM routed) WHERE rn = 1),
facts AS (SELECT o.*, d.disease FROM once o JOIN d USING (doc_id) WHERE t <> d.disease),
ids AS (SELECT *, 'Disease:' || sha1('Disease:' || disease) AS own, label || ':' || sha1(label || ':' || t) AS other FROM facts)"""
EDGES_SQL = f"""{EXTRACT_SQL}
SELECT src, dst, rel_type, source_doc_id, evidence, CAST(confidence AS DOUBLE) AS confidence, section FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, rel_type, source_doc_id ORDER BY confidence DESC, evidence, section) AS rn
 FROM (SELECT CASE WHEN label = 'Drug' THEN other ELSE own END AS src, CASE WHEN label = 'Drug' THEN own ELSE other END AS dst, kind AS rel_type, doc_id AS source_doc_id, s AS evidence, c AS confidence, heading AS section FROM ids)) WHERE rn = 1"""
NODES_SQL = f"""{EXTRACT_SQL}, n AS (SELECT 'Disease:' || sha1('Disease:' || disease) AS node_id, disease AS name, 'Disease' AS label, doc_id, disease || '的摘要' AS description FROM d UNION ALL SELECT other, t, label, doc_id, '' FROM ids)
SELECT node_id, min(name) AS name, min(label) AS label, list_sort(list(DISTINCT doc_id)) AS docs, coalesce(max(nullif(description, '')), '') AS description FROM n GROUP BY node_id"""
