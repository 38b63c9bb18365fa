from graphloom import lexicon as lx
from graphloom.operators import extract as ex

SCHEMA = "doc_id string, title string, keyword string, summary string, sections array<struct<heading string, content string>>, basic_info map<string, string>"


def test_relations_of_the_infobox(spark):
    a, b = lx.RECALL_SYMPTOMS[:2]
    cure = lx.RECALL_TREATMENTS[0]
    rows = [("1", "高血压", "高血压", "", [], {"常见症状": f"{a}、{b}、无关词", "治疗方法": f"{cure}，也可化疗。", "其他": a, "典型症状": None}), ("2", "糖尿病", "糖尿病", "", [], None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    nodes, edges = ex.extract(docs)
    names = {r.node_id: r.name for r in nodes.collect()}
    got = {(r.rel_type, names[r.dst], r.section, r.source_doc_id): r.confidence for r in edges.collect()}
    symptoms = {k[1]: v for k, v in got.items() if k[0] == "HAS_SYMPTOM"}
    assert symptoms == {a: 0.92, b: 0.92}
    assert {cure, "化疗"} <= {k[1] for k in got if k[0] == "TREATED_BY" and k[2:] == ("治疗方法", "1")}
    assert ex.extract(docs.drop("basic_info"))[1].count() == 0


def test_vocabulary_tests_the_normalised_heading(spark):
    rows = [("1", "x", "x", "", [("（某某综合征）", "a"), ("甲乙丙丁戊己庚辛壬癸子丑寅卯综合征", "a")], None)]
    terms = {r[0] for r in ex.vocabulary(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert "某某综合征" in terms and "甲乙丙丁戊己庚辛壬癸子丑寅卯综合征" not in terms
