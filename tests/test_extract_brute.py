"""Extraction against plain Python over the same documents."""

import hashlib
import re
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

from graphloom import lexicon as lx
from graphloom.functions.plain import clean_text
from graphloom.operators import extract as ex
from graphloom.operators.merge import best_edges, merge_nodes
from graphloom.plans.extraction_queries import medical_documents

DATA = "/root/testdata/sf0.001"
EDGE = " ：:，,。；;、"
LEAD = "如|例如|比如|包括|主要包括|常见|主要|可|会|需|应|的|发生"
LIST_LEAD = "包括|主要包括|有|为|如|例如|可见|可有|可出现|会出现|表现为|主要表现为|症状为|特征为"
CJK = "一-鿿"


def name_of(text):
    text = re.sub(r"[）)】\]]+$", "", re.sub(r"^[（(【\[]+", "", clean_text(text))).strip(EDGE)
    return re.sub("(?:等|等等|为主|之一|相关)$", "", re.sub(f"^(?:{LEAD})", "", text)).strip(EDGE)


def fits(text, limit):
    term = name_of(text)
    return 2 <= len(term) <= limit and bool(re.search(f"[{CJK}A-Za-z0-9]", term)) and not re.search("[，,。；;]", term)


def listed(text, limit):
    head = re.sub(f"^(?:{LIST_LEAD})[:：]?", "", re.split("[。！？!?；;]", name_of(text), maxsplit=1)[0])
    items = [re.sub("^[一二三四五六七八九十]+[、.]", "", re.sub(r"^\d+[.、]", "", name_of(p))) for p in re.split("[、，,；;/|]|以及|或者|或|和|与", head)]
    return [p for p in dict.fromkeys(items) if fits(p, limit)]


def lines_of(text):
    return [s.strip() for line in clean_text(text).splitlines() for s in re.split("(?<=[。！？!?；;])", line) if s.strip()]


def known(text, terms):
    return [t for t in sorted(dict.fromkeys(terms), key=len, reverse=True) if t in text]


def symptom(term):
    return term in lx.RECALL_SYMPTOMS or any(term.endswith(e) for e in lx.RECALL_SYMPTOM_ENDINGS)


def symptoms(s):
    terms = known(s, lx.RECALL_SYMPTOMS)
    places = [(s.find(m), k, m) for k, m in enumerate(lx.RECALL_LIST_MARKERS) if m in s]
    if places:
        at, _, mark = min(places)
        terms += listed(s[at + len(mark) :], 14)
    at = 0
    while at < len(s):  # the longest word of the dictionary at each place
        word = max((w for w in ex.DICTIONARY if s.startswith(w, at)), key=len, default="")
        terms += [word] if word and fits(word, 12) and symptom(name_of(word)) else []
        at += len(word) or len(re.match(r"[A-Za-z0-9]*", s[at:])[0]) or 1
    return [t for t in map(name_of, terms) if fits(t, 14) and symptom(t)]


def matched(s, pattern, limit):
    return [t for t in dict.fromkeys(map(name_of, re.findall(pattern, s))) if fits(t, limit)]


def drugs(s):
    pattern = f"[{CJK}A-Za-z0-9β-]{{2,24}}(?:药|药物|素|片|胶囊|剂|针|酯|胺|霉素|沙星|他汀|普利|沙坦|洛尔|地平|拉唑)"
    return [t for t in map(name_of, known(s, lx.RECALL_DRUGS) + matched(s, pattern, 24)) if fits(t, 24)]


def exams(s):
    pattern = f"[{CJK}A-Za-z0-9-]{{1,24}}(?:检查|检测|检验|测定|试验|造影|心电图|CT|MRI|超声|胃镜|肠镜|血常规|尿常规)"
    return [t for t in map(name_of, known(s, lx.RECALL_EXAMS) + matched(s, pattern, 24)) if fits(t, 24)]


def treatments(s):
    terms = known(s, lx.RECALL_TREATMENTS)
    for cues, term in ((("手术",), "手术治疗"), (("化疗",), "化疗"), (("放疗",), "放疗"), (("康复",), "康复治疗"), (("饮食", "营养"), "饮食控制"), (("运动",), "运动治疗")):
        terms += [term] if any(c in s for c in cues) else []
    return [t for t in map(name_of, terms) if fits(t, 18) and not re.search("[?？]", t) and t.count("（") == t.count("）") and t.count("(") == t.count(")")]


def complications(s, vocabulary):
    if not any(c in s for c in ("并发", "合并")):
        return []
    out = []
    for term in matched(s, f"[{CJK}A-Za-z0-9β-]{{2,10}}(?:{'|'.join(lx.RECALL_DISEASE_ENDINGS)})", 14):
        value = re.split("[:：]", name_of(term), maxsplit=1)[0]
        for trigger in ("导致", "引发", "引起", "造成", "诱发", "出现", "并发", "包括", "发生"):
            value = value.split(trigger, 1)[1] if trigger in value else value
        value = name_of(value)
        if fits(value, 14) and not any(b in value for b in ("症状", "诊断", "检查", "体检", "治疗", "生活质量")) and any(e in value for e in lx.RECALL_DISEASE_ENDINGS) and value in vocabulary:
            out.append(value)
    return out


def rated(base, cap=1.0):
    exact = Decimal(repr(max(0.0, min(0.99, 0.75 * base + 0.25 * 0.5))))
    return min(float(exact.quantize(Decimal("0.01"), ROUND_HALF_UP)), cap)


def ident(label, name):
    return f"{label}:" + hashlib.sha1(f"{label}:{name}".encode()).hexdigest()


def brute(docs):
    """{(src, dst, type, doc): {(confidence, evidence, section)}} and {node: (name, label, docs)}."""
    vocabulary = set(lx.RECALL_DISEASES)
    for d in docs:
        vocabulary |= {name_of(x) for x in (d.title, d.keyword) if fits(x, 24)}
        vocabulary |= {name_of(s.heading) for s in d.sections if any(e in name_of(s.heading) for e in lx.RECALL_DISEASE_ENDINGS) and fits(s.heading, 14)}
    edges, nodes = defaultdict(set), defaultdict(set)
    for d in docs:
        disease = name_of(d.title or d.keyword)
        nodes[ident("Disease", disease), disease, "Disease"].add(d.doc_id)

        def add(label, kind, found, heading, reverse=False):
            seen = set()
            for term, evidence, confidence in found:
                if term in seen:
                    continue
                seen.add(term)
                if term != disease:
                    nodes[ident(label, term), term, label].add(d.doc_id)
                    ends = (ident("Disease", disease), ident(label, term))
                    edges[(*(ends[::-1] if reverse else ends), kind, d.doc_id)].add((confidence, evidence, heading))

        def per_sentence(text, take, base, cap=1.0, when=lambda s: True):
            return [(t, s, rated(base, cap)) for s in lines_of(text) if when(s) for t in take(s)]

        for section in d.sections:
            h, text = clean_text(section.heading), section.content
            in_heading = lambda words, h=h: any(w in h for w in words)
            has = lambda *words: lambda s: any(w in s for w in words)
            if in_heading(lx.RECALL_SYMPTOM_HEADINGS):
                add("Symptom", "HAS_SYMPTOM", per_sentence(text, symptoms, 0.86), h)
            if in_heading(lx.RECALL_EXAM_HEADINGS):
                add("Examination", "REQUIRES_EXAM", per_sentence(text, exams, 0.86), h)
            if in_heading([*lx.RECALL_DRUG_HEADINGS, *lx.RECALL_TREATMENT_HEADINGS]):
                add("Drug", "TREATS_DISEASE", per_sentence(text, drugs, 0.86), h, True)
            if in_heading(lx.RECALL_TREATMENT_HEADINGS):
                own = [(name_of(h), name_of(h), rated(0.9))] if "治疗" in name_of(h) and fits(h, 18) else []
                add("Treatment", "TREATED_BY", own + per_sentence(text, treatments, 0.84), h)
            if in_heading(lx.RECALL_COMPLICATION_HEADINGS):
                add("Disease", "HAS_COMPLICATION", per_sentence(text, lambda s: complications(s, vocabulary), 0.82), h)
            add("Symptom", "HAS_SYMPTOM", per_sentence(text, symptoms, 0.86, 0.82, has("症状", "表现", "出现", "伴有", "可见")), h)
            add("Examination", "REQUIRES_EXAM", per_sentence(text, exams, 0.86, 0.82, has(*"检查 检验 检测 诊断 造影 心电图 CT MRI 超声".split())), h)
            cures = has(*"治疗 手术 康复 饮食 运动 介入 透析 氧疗".split())
            add("Drug", "TREATS_DISEASE", per_sentence(text, drugs, 0.86, 0.82, cures), h, True)
            add("Treatment", "TREATED_BY", per_sentence(text, treatments, 0.84, 0.80, cures), h)
        for key, value in d.basic_info.items():
            h, value = name_of(key), clean_text(value)
            if "症状" in h:
                add("Symptom", "HAS_SYMPTOM", [(t, value, 0.92) for t in listed(value, 14) if symptom(t)], h)
            elif "治疗" in h:
                own = [(h, h, rated(0.9))] if fits(h, 18) and any(w in h for w in lx.RECALL_TREATMENT_HEADINGS) else []
                add("Treatment", "TREATED_BY", own + per_sentence(value, treatments, 0.84), h)
    return edges, nodes


def test_extraction_by_brute_force(spark):
    frame = medical_documents(spark, "/root/testdata/sf0.01")
    expected, named = brute(frame.collect())
    nodes, edges = ex.extract(frame)
    got = {(r.src, r.dst, r.rel_type, r.source_doc_id): (r.confidence, r.evidence, r.section) for r in best_edges(edges).collect()}
    assert got.keys() == expected.keys() and len(got) > 1000
    for key, row in got.items():
        assert row[0] == max(c for c, _, _ in expected[key]), (key, row, expected[key])
        assert row in expected[key]
    assert {(r.node_id, r.name, r.label, tuple(r.docs)) for r in merge_nodes(nodes, longest=False).collect()} == {(i, n, label, tuple(sorted(docs))) for (i, n, label), docs in named.items()}
