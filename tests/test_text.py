import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import extract as ex
from graphloom.operators import quality as qa
from graphloom.schema import MEDICAL


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, expected",
    [("血压&amp;心率[1]　升高\r\n\n  二[2-3]行 ", "血压&心率 升高\n二行"), ("x[1,2]", "x[1,2]"), (None, ""), ("  a\t b \n\n c", "a b\nc"), ("a b\x85c", "a\nb\nc")],
)
def test_clean_text(spark, text, expected):
    assert one(spark, text, lambda c: tx.clean_text(c, tx.html_unescape)) == expected


def test_terms(spark):
    assert one(spark, "（主要包括头晕等）", tx.term_name) == "头晕"
    assert one(spark, "包括头晕、心悸和乏力等。其他", tx.split_terms) == ["头晕", "心悸", "乏力"]
    assert one(spark, "主要表现为头痛、恶心。", lambda c: tx.split_terms(tx.after_marker(c, ["表现为", "有"]))) == ["头痛", "恶心"]
    assert one(spark, "其他", lambda c: tx.after_marker(c, ["表现为"])) is None
    assert one(spark, "一。二！三；四\n五", tx.sentences) == ["一。", "二！", "三；", "四", "五"]
    assert one(spark, "x" * 200, tx.short_evidence) == "x" * 180 + "..."
    assert one(spark, "可并发上消化道出血", ex.refine_disease) == "上消化道出血"


@pytest.mark.parametrize("name, label, expected", [("伴有 头痛等症状", "Symptom", "头痛"), ("口服阿司匹林", "Drug", "阿司匹林"), ("严重的明显头痛症状", "Symptom", "头痛"), ("ＣＴ等检查", "Examination", "CT")])
def test_node_name(spark, name, label, expected):
    assert one(spark, name, lambda c: tx.node_name(c, F.lit(label))) == expected


@pytest.mark.parametrize(
    "name, label, expected",
    [
        ("头痛", "Symptom", None),
        ("贫血", "Symptom", "symptom_is_disease"),
        ("无发热", "Symptom", "negated_symptom"),
        ("降压药", "Drug", "generic_term"),
        ("ABC123", "Drug", "drug_abbreviation_without_class"),
        ("影像学检查", "Examination", "generic_term"),
        ("药物治疗", "Treatment", "bad_fragment:药物治疗"),
        ("头痛", "Disease", "not_disease_like"),
        ("高血压", "Disease", None),
        ("x", "Nothing", "invalid_node_label"),
        ("", "Drug", "empty_name"),
        ("123", "Drug", "no_meaningful_text"),
        ("头痛（左", "Symptom", "unbalanced_bracket"),
        ("痛", "Symptom", "too_short"),
        ("3 年一次的CT", "Examination", "exam_phrase_with_de"),
        ("3年CT", "Examination", "time_expression"),
    ],
)
def test_node_reason(spark, name, label, expected):
    assert one(spark, name, lambda c: qa.node_reason(c, F.lit(label), MEDICAL)) == expected


@pytest.mark.parametrize("value, expected", [("0.9", 0.9), (" 1 ", 1.0), ("0.9f", None), ("nan", None), ("", None), (None, None), ("1_0", None), ("1e-1", 0.1)])
def test_parse_confidence(spark, value, expected):
    assert one(spark, value, tx.parse_confidence) == expected


def test_ids_and_scores(spark):
    assert one(spark, "高血压", lambda c: tx.stable_id(F.lit("Disease"), c)) == "Disease:77023716aa3f1cb029360ae1611d63a33a0ba3f9"
    assert one(spark, "d1, d2;d3", tx.split_ids) == ["d1", "d2", "d3"]
    assert one(spark, "x", lambda c: tx.confidence(F.lit(0.86), F.lit(0.5))) == 0.77
    row = spark.createDataFrame([("摘要", [("病因", "x")])], "s string, p array<struct<heading:string,content:string>>")
    assert row.select(tx.full_text(F.col("s"), F.col("p")).alias("r")).first()["r"] == "摘要\n\n病因\nx"
