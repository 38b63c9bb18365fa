"""Quality stage of a graph: every node and edge is kept, merged or rejected with the first reason that holds.

Rules are ladders of (reason, condition) over columns, so a stage is one projection per frame. Vocabularies
and the graph schema are arguments; those of the medical graph are the defaults.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import lexicon as lx
from graphloom.functions import text as tx
from graphloom.operators.extract import ends_with_any, has_any
from graphloom.operators.merge import best_edges, merge_nodes
from graphloom.schema import MEDICAL, REJECT_COLUMNS, GraphSchema

#: A rule gives a reason column: null where the name passes.
Rule = Callable[[Column], Column]
MEANINGFUL = "[\\u4e00-\\u9fffA-Za-z]"
# Phrase openings and words that betray a fragment of a sentence.
SYMPTOM_PHRASES = "时有 劳动 体力 诊治 甚至".split()
SYMPTOM_FOREIGN = "治疗 检查 诊断 药 疾病 患者".split()
DISEASE_FOREIGN = "症状 检查 治疗 药物 患者".split()
DRUG_OPENINGS = "^(?:L时|中度|也|仍|以|但|低剂量|作为|使|可|应|要|还应|对|不|严|则|在|同时|只|单凭|属|尽早|尚无|合适|合理|含量|因|当以)"
EXAM_OPENINGS = "^(?:与|为|不|中国|临床|人工智能|也有|之前|U指|仅|以|作为|依据|做|全面|其中|其他|具体|典型|在|基于|发病|凡|另外|含量|因此|完善|定期|对|必要|慢性|整个|无|最|能|考虑|属于|该|这类|须)"
DRUG_JOINTS, EXAM_JOINTS = "与 和 或 等 及".split(), "以及 和 及 或 等".split()


def ladder(*steps: tuple[str | Column, Column]) -> Column:
    """The reason of the first condition that holds; a reason may be null, which passes."""
    out = F.lit(None).cast("string")
    for reason, condition in reversed(steps):
        out = F.when(condition, F.lit(reason) if isinstance(reason, str) else reason).otherwise(out)
    return out


def passes() -> Column:
    return F.lit(None).cast("string")


def first_fragment(name: Column, fragments: list[str]) -> Column:
    """The first listed fragment that the name holds, or null."""
    return F.when(has_any(name, fragments), F.element_at(F.filter(F.array(*[F.lit(f) for f in fragments]), lambda f: F.contains(name, f)), 1))


def common_rule(name: Column, label: Column, schema: GraphSchema, generic: list[str], generic_by_label: dict[str, list[str]], fragments: list[str], fragments_by_label: dict[str, list[str]], punctuation: str = "[，。；！？]") -> Column:
    own_generic = F.lit(False)
    own_fragment = F.lit(None).cast("string")
    for key, words in generic_by_label.items():
        own_generic = own_generic | ((label == key) & name.isin(*words))
    for key, words in fragments_by_label.items():
        own_fragment = F.when(label == key, first_fragment(name, words)).otherwise(own_fragment)
    fragment = F.coalesce(first_fragment(name, fragments), own_fragment)
    return ladder(
        ("invalid_node_label", ~label.isin(*schema.labels) | label.isNull()),
        ("empty_name", name == ""),
        ("no_meaningful_text", ~name.rlike(MEANINGFUL)),
        ("sentence_like_punctuation", name.rlike(punctuation)),
        ("unbalanced_bracket", name.rlike("[(（][^()（）]*$")),
        ("generic_term", name.isin(*generic) | own_generic),
        (F.concat(F.lit("bad_fragment:"), fragment), fragment.isNotNull()),
        ("too_short", F.length(name) < 2),
    )


def disease_rule(n: Column) -> Column:
    return ladder(
        ("disease_name_too_long", F.length(n) > 24),
        ("disease_contains_non_disease_word", has_any(n, DISEASE_FOREIGN)),
        (passes(), n.isin(*lx.STRICT_DISEASES, "休克", "感染", "贫血")),
        ("not_disease_like", ~has_any(n, lx.STRICT_DISEASE_ENDINGS)),
    )


def symptom_rule(n: Column) -> Column:
    return ladder(
        ("symptom_name_too_long", F.length(n) > 14),
        ("negated_symptom", n.startswith("无")),
        ("symptom_is_disease", n.isin(*lx.STRICT_DISEASES)),
        ("symptom_phrase_fragment", has_any(n, SYMPTOM_PHRASES)),
        ("symptom_contains_wrong_domain_word", has_any(n, SYMPTOM_FOREIGN)),
        ("not_symptom_like", ~(has_any(n, lx.STRICT_SYMPTOMS) | ends_with_any(n, lx.STRICT_SYMPTOM_ENDINGS))),
    )


def drug_rule(n: Column) -> Column:
    short = F.length(n) <= 8
    return ladder(
        ("drug_name_too_long", F.length(n) > 20),
        (passes(), n.isin(*lx.STRICT_DRUGS)),
        ("drug_phrase_prefix", n.rlike(DRUG_OPENINGS)),
        ("drug_abbreviation_without_class", n.rlike(r"^[A-Za-z0-9βα+\-/]+$")),
        ("compound_or_sentence_fragment", has_any(n, DRUG_JOINTS)),
        ("drug_phrase_with_de", F.contains(n, F.lit("的"))),
        ("not_drug_like", ~(has_any(n, lx.STRICT_DRUG_MARKERS) | (short & (n.endswith("药") | n.endswith("素"))))),
    )


def exam_rule(n: Column) -> Column:
    return ladder(
        ("exam_name_too_long", F.length(n) > 24),
        (passes(), n.isin(*lx.STRICT_EXAMS)),
        ("exam_phrase_prefix", n.rlike(EXAM_OPENINGS)),
        ("exam_phrase_with_de", F.contains(n, F.lit("的"))),
        ("time_expression", n.rlike(r"(?U)\d+\s*年")),
        ("compound_exam", has_any(n, EXAM_JOINTS)),
        ("not_exam_like", ~has_any(n, lx.STRICT_EXAM_MARKERS)),
    )


def treatment_rule(n: Column) -> Column:
    return ladder(
        ("treatment_name_too_long", F.length(n) > 18),
        (passes(), n.isin(*lx.STRICT_TREATMENTS)),
        ("not_treatment_like", ~has_any(n, lx.STRICT_TREATMENT_MARKERS)),
    )


MEDICAL_RULES: dict[str, Rule] = {"Disease": disease_rule, "Symptom": symptom_rule, "Drug": drug_rule, "Examination": exam_rule, "Treatment": treatment_rule}
MEDICAL_FRAGMENTS = {"Drug": lx.STRICT_DRUG_FRAGMENTS, "Examination": lx.STRICT_EXAM_FRAGMENTS, "Treatment": lx.STRICT_TREATMENT_FRAGMENTS}


def node_reason(
    name: Column,
    label: Column,
    schema: GraphSchema = MEDICAL,
    rules: dict[str, Rule] | None = None,
    generic: list[str] = lx.STRICT_GENERIC,
    generic_by_label: dict[str, list[str]] | None = None,
    fragments: list[str] = lx.STRICT_FRAGMENTS,
    fragments_by_label: dict[str, list[str]] | None = None,
) -> Column:
    """Why a normalised name isn't a node of that label, or null."""
    rules = MEDICAL_RULES if rules is None else rules
    own = F.lit(None).cast("string")
    for key, rule in rules.items():
        own = F.when(label == key, rule(name)).otherwise(own)
    common = common_rule(name, label, schema, generic, lx.STRICT_GENERIC_BY_LABEL if generic_by_label is None else generic_by_label, fragments, MEDICAL_FRAGMENTS if fragments_by_label is None else fragments_by_label)
    return F.coalesce(common, own)


def rejects(frame: DataFrame, **columns: Column) -> DataFrame:
    return frame.select(*[columns.get(c, F.lit("")).cast("string").alias(c) for c in REJECT_COLUMNS])


def judge_nodes(nodes: DataFrame, normal_name: Callable[[Column, Column], Column] | None = None, reason: Callable[[Column, Column], Column] = node_reason) -> DataFrame:
    """nodes(node_id, name, label, source_doc_ids, description, seq) with clean_name, reason and clean_id."""
    normal_name = tx.node_name if normal_name is None else normal_name
    label = F.coalesce(F.trim("label"), F.lit(""))
    named = nodes.withColumn("label", label).withColumn("clean_name", normal_name(F.col("name"), F.col("label")))
    judged = named.withColumn("reason", reason(F.col("clean_name"), F.col("label")))
    return judged.withColumn("clean_id", F.when(F.col("reason").isNull(), tx.stable_id(F.col("label"), F.col("clean_name"))))


def node_rejects(judged: DataFrame) -> DataFrame:
    bad = judged.filter("reason is not null")
    name = F.when(F.col("clean_name") != "", F.col("clean_name")).otherwise(F.col("name"))
    return rejects(bad, item_type=F.lit("node"), reason=F.col("reason"), id=F.col("node_id"), name=name, type=F.col("label"), source_doc_id=F.col("source_doc_ids"))


def clean_nodes(judged: DataFrame) -> DataFrame:
    good = judged.filter("reason is null")
    return merge_nodes(good.select(F.col("clean_id").alias("node_id"), F.col("clean_name").alias("name"), "label", tx.split_ids(F.coalesce("source_doc_ids", F.lit(""))).alias("docs"), F.coalesce("description", F.lit("")).alias("description"), "seq"), longest=True)


def judge_edges(edges: DataFrame, judged: DataFrame, schema: GraphSchema = MEDICAL, least: float = 0.85, least_evidence: int = 4, tidy: Callable[[Column], Column] = F.trim) -> DataFrame:
    """edges(src, dst, rel_type, source_doc_id, evidence, confidence string, section) with value, ends and reason.

    The ends are looked up in the judged nodes; the schema is a literal, not a join. An edge whose own fields reject it
    needs no ends, so only the others are shuffled, with the names of their ends rather than the ids made of these.
    """
    # a raw id met twice maps to the clean id met last
    ids = judged.filter("clean_id is not null").groupBy("node_id").agg(F.max(F.struct("seq", "clean_id", "label", "clean_name")).alias("m")).select("node_id", "m.label", F.col("m.clean_name").alias("name"))
    out = edges.select(F.trim("src").alias("src"), F.trim("dst").alias("dst"), tidy(F.col("rel_type")).alias("rel_type"), tidy(F.col("source_doc_id")).alias("source_doc_id"), tidy(F.coalesce("evidence", F.lit(""))).alias("evidence"), F.col("confidence").alias("given"), tidy(F.coalesce("section", F.lit(""))).alias("section"))
    out = out.withColumn("confidence", tx.parse_confidence(F.col("given")))
    own = ladder(
        ("invalid_relationship_type", F.coalesce(~F.col("rel_type").isin(*schema.relations), F.lit(True))),
        ("invalid_confidence", F.col("confidence").isNull()),
        ("low_confidence", F.col("confidence") < least),
    )
    out = out.withColumn("own", own).withColumn("short", F.length("evidence") < least_evidence)
    ends = [x for end in ("src", "dst") for x in (f"{end}_label", f"{end}_name")]
    alone = out.filter("own is not null").withColumns({c: F.lit(None).cast("string") for c in ends})
    sought = out.filter("own is null")
    for end in ("src", "dst"):
        sought = sought.join(ids.select(F.col("node_id").alias(end), F.col("label").alias(f"{end}_label"), F.col("name").alias(f"{end}_name")), end, "left")
    out = alone.unionByName(sought)
    fits = reduce(lambda a, b: a | b, [(F.col("rel_type") == t) & (F.col("src_label") == a) & (F.col("dst_label") == b) for t, (a, b) in schema.relations.items()])
    wrong = F.concat(F.lit("direction_or_label_mismatch:"), "src_label", F.lit("->"), "dst_label")
    reason = ladder(
        (F.col("own"), F.col("own").isNotNull()),
        ("endpoint_node_rejected_or_missing", F.col("src_name").isNull() | F.col("dst_name").isNull()),
        (wrong, ~fits),
        ("evidence_too_short", F.col("short")),
    )
    return out.withColumns({"reason": reason, **{f"new_{end}": tx.stable_id(F.col(f"{end}_label"), F.col(f"{end}_name")) for end in ("src", "dst")}}).drop("own", "short")


def edge_rejects(judged: DataFrame) -> DataFrame:
    bad = judged.filter("reason is not null")
    return rejects(bad, item_type=F.lit("relationship"), reason=F.col("reason"), start_id=F.col("src"), end_id=F.col("dst"), relationship_type=F.col("rel_type"), confidence=F.col("given"), evidence=F.col("evidence"), source_doc_id=F.col("source_doc_id"))


#: What an accepted edge is told by: its ends by label and name, of which their ids are made, and the rest of its key.
END_KEY = ("src_label", "src_name", "dst_label", "dst_name", "rel_type", "source_doc_id")


def clean_edges(judged: DataFrame) -> DataFrame:
    good = judged.filter("reason is null").select(*END_KEY, "evidence", "confidence", "section")
    best = best_edges(good, key=END_KEY)
    return best.select(*clean_ends(), "rel_type", "source_doc_id", "evidence", "confidence", "section")


def clean_ends() -> list[Column]:
    return [tx.stable_id(F.col(f"{end}_label"), F.col(f"{end}_name")).alias(end) for end in ("src", "dst")]


def referenced(edges: DataFrame) -> DataFrame:
    """Distinct ends of edges (src, dst), from one pass over them."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()


def prune(nodes: DataFrame, edges: DataFrame, keep_label: str) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): nodes of ``keep_label`` or with an edge, and the others. One join decides both."""
    marked = nodes.join(referenced(edges).withColumn("used", F.lit(True)), "node_id", "left").withColumn("keep", (F.col("label") == keep_label) | F.coalesce("used", F.lit(False)))
    return marked.filter("keep").drop("used", "keep"), marked.filter("not keep").drop("used", "keep")


def edges_between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("node_id")
    return edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def prune_rejects(pruned: DataFrame) -> DataFrame:
    return rejects(pruned, item_type=F.lit("node"), reason=F.lit("unreferenced_after_relationship_filter"), id=F.col("node_id"), name=F.col("name"), type=F.col("label"), source_doc_id=F.concat_ws(";", "docs"))


def good_edges(judged: DataFrame) -> DataFrame:
    """Accepted edges with their clean ends, before equal ones are merged."""
    return judged.filter("reason is null").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "rel_type", "source_doc_id")


@dataclass(frozen=True)
class Outputs:
    """What the stage gives: clean nodes and edges, every rejected row with its reason, and counts."""

    nodes: DataFrame
    edges: DataFrame
    rejects: DataFrame
    summary: DataFrame


def postprocess(judged_nodes: DataFrame, judged_edges: DataFrame, keep_label: str) -> Outputs:
    """The four outputs from judged nodes and edges.

    Nodes without an edge are pruned, but for those of ``keep_label``. An accepted edge's ends are accepted nodes
    and have an edge, so no clean edge loses an end, and pruning needs the ends only, not the merged edges.
    """
    merged, good = clean_nodes(judged_nodes), good_edges(judged_edges)
    kept, pruned = prune(merged, good, keep_label)
    rejected = node_rejects(judged_nodes).unionByName(edge_rejects(judged_edges)).unionByName(prune_rejects(pruned))
    return Outputs(kept, clean_edges(judged_edges), rejected, summary(judged_nodes, judged_edges, keep_label))


def summary(judged_nodes: DataFrame, judged_edges: DataFrame, keep_label: str) -> DataFrame:
    """(metric, value): rows in, kept, rejected (pruned nodes among them) and merged into equal ones, so that each sum comes out.

    One pass over the edges: equal ones are counted together (rejected ones as one group without ends), and their
    counts are carried to their ends, where the clean nodes meet them.
    """
    nodes = judged_nodes.agg(F.count(F.lit(1)).alias("in_nodes"), F.count_if(F.col("reason").isNotNull()).alias("bad_nodes"))
    equal = judged_edges.select(*[F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in END_KEY]).groupBy(*END_KEY).agg(F.count(F.lit(1)).alias("n"))
    end = lambda side, edges, rows: F.struct(F.col(f"{side}_label").alias("label"), F.col(f"{side}_name").alias("name"), edges.alias("edges"), rows.alias("rows"))
    ends = equal.select(F.explode(F.array(end("src", F.lit(1), F.col("n")), end("dst", F.lit(0), F.lit(0).cast("long")))).alias("e")).select("e.*")
    ends = ends.groupBy("label", "name").agg(F.sum("edges").alias("edges"), F.sum("rows").alias("rows"))
    clean = judged_nodes.filter("reason is null").select("label", F.col("clean_name").alias("name")).distinct().withColumn("clean", F.lit(True))
    marked = clean.join(ends, ["label", "name"], "full")
    keep, known = (F.col("label") == keep_label) | F.col("edges").isNotNull(), F.col("name").isNotNull()
    total = lambda column, where: F.coalesce(F.sum(F.when(where, F.col(column))), F.lit(0))
    counts = marked.agg(
        F.count_if(F.col("clean") & keep).alias("kept_nodes"),
        F.count_if(F.col("clean") & ~keep).alias("pruned"),
        total("rows", F.lit(True)).alias("in_edges"),
        total("rows", ~known).alias("bad_edges"),
        total("edges", known).alias("kept_edges"),
    )
    row = nodes.crossJoin(F.broadcast(counts))  # one row each
    c = F.col
    values = {
        "input_nodes": c("in_nodes"),
        "kept_nodes": c("kept_nodes"),
        "rejected_nodes": c("bad_nodes") + c("pruned"),
        "merged_nodes": c("in_nodes") - c("bad_nodes") - c("kept_nodes") - c("pruned"),
        "input_relationships": c("in_edges"),
        "kept_relationships": c("kept_edges"),
        "rejected_relationships": c("bad_edges"),
        "merged_relationships": c("in_edges") - c("bad_edges") - c("kept_edges"),
        "total_rejected_rows": c("bad_nodes") + c("pruned") + c("bad_edges"),
    }
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in values.items()])).alias("m")).select("m.*")


def import_nodes(rows: DataFrame, schema: GraphSchema) -> DataFrame:
    """Node rows with ``ok``: a label of the schema, an id and a name."""
    ok = F.coalesce(F.col("label").isin(*schema.labels) & (F.trim("node_id") != "") & (F.trim("name") != ""), F.lit(False))
    return rows.withColumn("ok", ok)


def import_edges(rows: DataFrame, schema: GraphSchema) -> DataFrame:
    """Edge rows with ``ok`` and confidence (0 where it can't be read): both ids are given and their labels fit the type."""
    fits = reduce(lambda a, b: a | b, [(F.col("rel_type") == t) & (tx.label_of(F.col("src")) == a) & (tx.label_of(F.col("dst")) == b) for t, (a, b) in schema.relations.items()])
    ok = F.coalesce(fits & (F.trim("src") != "") & (F.trim("dst") != ""), F.lit(False))
    return rows.withColumn("ok", ok).withColumn("confidence", F.coalesce(tx.parse_confidence(F.col("confidence")), F.lit(0.0)))


def repeated_keys(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that break uniqueness; empty when the constraint holds."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def clear(nodes: DataFrame, edges: DataFrame, labels: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The graph without nodes(node_id, labels array) of those labels and without the edges at them."""
    gone = F.arrays_overlap("labels", F.array(*[F.lit(x) for x in labels]))
    removed = nodes.filter(gone).select("node_id")
    left = edges.join(removed.withColumnRenamed("node_id", "src"), "src", "left_anti").join(removed.withColumnRenamed("node_id", "dst"), "dst", "left_anti")
    return nodes.filter(~gone), left
