"""Extraction steps. The trade tables hold no medical text, so steps that need it run on sentences made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import lexicon as lx
from graphloom.functions import text as tx
from graphloom.operators import extract as ex
from graphloom.operators.merge import best_edges, merge_nodes
from graphloom.plans import medical_sql
from graphloom.plans.registry import query
from graphloom.plans.trade import GRAPH_SQL, load, raw_edges

SENTENCES_SQL = "list_filter(list_transform(flatten(list_transform(string_split(text, chr(10)), lambda l: regexp_extract_all(l, '[^.]*[.]|[^.]+'))), lambda s: trim(s)), lambda s: s <> '')"


@query(f"SELECT doc_id, len({SENTENCES_SQL}) AS n, sha256(array_to_string({SENTENCES_SQL}, '|')) AS digest FROM documents")
def ext_sentences(spark, d):
    docs = load(spark, d, "documents").select("doc_id", tx.sentences(F.col("text"), ".").alias("s"))
    return docs.select("doc_id", F.size("s").cast("long").alias("n"), F.sha2(F.array_join("s", "|").cast("binary"), 256).alias("digest"))


TERMS = ["hand", "thing", "elle", "mente", "keit", "the", "ring"]


@query(
    f"""WITH s AS (SELECT doc_id, unnest({SENTENCES_SQL}) AS sentence FROM documents), t AS (SELECT unnest({TERMS!r}) AS term)
SELECT doc_id, term, count(*) AS n FROM s JOIN t ON contains(sentence, term) GROUP BY doc_id, term"""
)
def ext_known_terms(spark, d):
    lines = load(spark, d, "documents").select("doc_id", F.explode(tx.sentences(F.col("text"), ".")).alias("sentence"))
    return lines.select("doc_id", F.explode(ex.known_terms(F.col("sentence"), TERMS)).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, array_to_string(list_filter({sorted(TERMS, key=lambda t: -len(t))!r}, lambda w: contains(text, w)), ',') AS terms FROM documents")
def ext_known_order(spark, d):
    return load(spark, d, "documents").select("doc_id", F.array_join(ex.known_terms(F.col("text"), TERMS), ",").alias("terms"))


ENDINGS = "[A-Za-z]{2,24}(?:tion|ment|keit)"


@query(f"SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{ENDINGS}')) AS term FROM documents) WHERE length(term) BETWEEN 2 AND 12")
def ext_pattern_terms(spark, d):
    return load(spark, d, "documents").select("doc_id", F.explode(ex.pattern_terms(F.col("text"), ENDINGS, 12)).alias("term"))


ITEMS_SQL = f"""list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_split_to_array(trim(text), '[{tx.SENTENCE_END}]')[1], '{tx.LIST_LEADS}', ''), '{tx.LIST_CUT}'),
 lambda p: regexp_replace(regexp_replace(trim(p), '^[0-9]+[.、]', ''), '^[一二三四五六七八九十]+[、.]', '')), lambda p: length(trim(p)) BETWEEN 2 AND 24 AND regexp_matches(p, '[一-鿿A-Za-z0-9]') AND NOT regexp_matches(p, '[，,。；;]')))"""


@query(f"SELECT doc_id, CAST(len(i) AS BIGINT) AS n, list_min(i) AS least FROM (SELECT doc_id, {ITEMS_SQL} AS i FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '包括' WHEN 1 THEN '1.' ELSE '' END || replace(text, '.', '、') AS text FROM documents)) WHERE len(i) > 0")
def ext_list_terms(spark, d):
    k = F.col("doc_id")
    text = F.concat(F.when(k % 3 == 0, "包括").when(k % 3 == 1, "1.").otherwise(""), F.replace("text", F.lit("."), F.lit("、")))
    docs = load(spark, d, "documents").select("doc_id", tx.split_terms(text, 24, F.trim).alias("t"))
    return docs.filter(F.size("t") > 0).select("doc_id", F.size("t").cast("long").alias("n"), F.array_min("t").alias("least"))


@query(
    f"""WITH s AS (SELECT doc_id, unnest({SENTENCES_SQL}) AS sentence, generate_subscripts({SENTENCES_SQL}, 1) - 1 AS pos FROM documents), t AS (SELECT unnest({TERMS!r}) AS term)
SELECT doc_id, term, CAST(min(pos) AS INTEGER) AS sent_pos, sha256(arg_min(sentence, pos)) AS evidence_hash FROM s JOIN t ON contains(sentence, term) GROUP BY doc_id, term"""
)
def ext_first_occurrence(spark, d):
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"), ".")).alias("sent_pos", "sentence"))
    hits = lines.select("*", F.posexplode(ex.known_terms(F.col("sentence"), TERMS)).alias("cand_pos", "term"))
    first = ex.first_occurrences(hits, ["doc_id", "term"])
    return first.select("doc_id", "term", "sent_pos", F.sha2(F.col("sentence").cast("binary"), 256).alias("evidence_hash"))


MARKS = ["the", " de ", "die"]
PLACES_SQL = "list_filter([(instr(text, 'the'), 3), (instr(text, ' de '), 4), (instr(text, 'die'), 3)], lambda p: p[1] > 0)"


@query(f"SELECT doc_id, sha256(substr(text, first[1] + first[2])) AS rest FROM (SELECT doc_id, text, list_min({PLACES_SQL}) AS first FROM documents) WHERE first IS NOT NULL")
def ext_first_marker(spark, d):
    docs = load(spark, d, "documents").select("doc_id", tx.after_marker(F.col("text"), MARKS).alias("rest"))
    return docs.filter(F.col("rest").isNotNull()).select("doc_id", F.sha2(F.col("rest").cast("binary"), 256).alias("rest"))


@query("SELECT doc_id, string_agg(length(s), ',' ORDER BY i) AS sizes FROM (SELECT doc_id, i, CASE WHEN length(t) > 180 THEN substr(t, 1, 180) || '...' ELSE t END AS s FROM (SELECT doc_id, 0 AS i, trim(regexp_replace(text, '[\\n]+', ' ', 'g')) AS t FROM documents)) GROUP BY doc_id")
def ext_evidence(spark, d):
    return load(spark, d, "documents").select("doc_id", F.length(tx.short_evidence(F.col("text"))).cast("string").alias("sizes"))


@query("SELECT role || '-' || turn AS heading, count(*) AS n, count(*) FILTER (role LIKE '%assist%') AS a, count(*) FILTER (regexp_matches(text, 'the|elle')) AS b FROM conversations GROUP BY role, turn")
def ext_heading_route(spark, d):
    turns = load(spark, d, "conversations").withColumn("heading", F.concat_ws("-", "role", F.col("turn").cast("string")))
    by_heading, by_sentence = ex.has_any(F.col("heading"), ["assist"]), ex.has_any(F.col("text"), ["the", "elle"])
    return turns.groupBy("heading").agg(F.count(F.lit(1)).alias("n"), F.count_if(by_heading).alias("a"), F.count_if(by_sentence).alias("b"))


@query("WITH a AS (SELECT label, embedding FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn = 1) SELECT e.vec_id, round(greatest(0, least(1, (list_cosine_similarity(e.embedding::DOUBLE[], a.embedding::DOUBLE[]) + 1) / 2)), 6) AS score FROM embeddings e JOIN a USING (label)")
def ext_anchor_score(spark, d):
    vectors = load(spark, d, "embeddings")
    anchors = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    return vectors.join(anchors, "label").select("vec_id", F.round(tx.cosine_score(F.col("embedding"), F.col("anchor")), 6).alias("score"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, CAST(round(CAST(CAST(greatest(0, least(0.99, 0.75 * (1 - l_discount) + 0.25 * l_tax)) AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE) AS confidence FROM lineitem")
def ext_confidence(spark, d):
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), tx.confidence(1 - F.col("l_discount"), F.col("l_tax")).alias("confidence"))


@query(
    """SELECT 'Part:' || sha1('Part:' || p_name) AS node_id, count(DISTINCT p_partkey) AS n_docs, coalesce(min_by(p_type, p_partkey) FILTER (p_partkey % 3 <> 0), '') AS description FROM part GROUP BY p_name"""
)
def ext_nodes_merge(spark, d):
    part = load(spark, d, "part")
    nodes = part.select(tx.stable_id(F.lit("Part"), F.col("p_name")).alias("node_id"), F.col("p_name").alias("name"), F.lit("Part").alias("label"), F.array(F.col("p_partkey").cast("string")).alias("docs"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type")).alias("description"), F.col("p_partkey").alias("seq"))
    return merge_nodes(nodes, longest=False).select("node_id", F.size("docs").cast("long").alias("n_docs"), "description")


@query(f"{GRAPH_SQL} SELECT src, dst, rel_type, source_doc_id, evidence, confidence, section FROM e")
def ext_edges_dedup(spark, d):
    return best_edges(raw_edges(spark, d))


@query(
    f"""SELECT DISTINCT term FROM (SELECT unnest({lx.RECALL_DISEASES!r}) AS term UNION ALL SELECT unnest({lx.RECALL_DISEASES!r}) FROM supplier UNION ALL SELECT unnest(['症状', '药物治疗', '检查', '并发症']) FROM supplier)
WHERE term IN {tuple(lx.RECALL_DISEASES)!r} OR len(list_filter({lx.RECALL_DISEASE_ENDINGS!r}, lambda e: contains(term, e))) > 0"""
)
def ext_vocab(spark, d):
    return ex.vocabulary(medical_documents(spark, d))


WORDS = ["red", "small ring", "ring", "blue"]
WORDS_SQL = "regexp_extract_all(p_name, 'small ring|blue|ring|red|[A-Za-z0-9]+|[^\\s]')"


@query(f"SELECT p_partkey, array_to_string(list_transform({WORDS_SQL}, lambda w: w || '/' || CASE WHEN w IN ('red', 'small ring', 'ring', 'blue') THEN 'n' WHEN regexp_matches(w, '^[A-Za-z0-9]') THEN 'eng' ELSE 'x' END), ' ') AS tagged FROM part")
def ext_tagged(spark, d):
    words = F.transform(ex.tagged(F.col("p_name"), WORDS), lambda t: F.concat_ws("/", t["word"], t["flag"]))
    return load(spark, d, "part").select("p_partkey", F.array_join(words, " ").alias("tagged"))


@query(f"SELECT p_partkey, term FROM (SELECT DISTINCT p_partkey, unnest({WORDS_SQL}) AS term FROM part) WHERE term IN ('red', 'small ring', 'ring', 'blue')")
def ext_lexical(spark, d):
    return load(spark, d, "part").select("p_partkey", F.explode(ex.lexical_candidates(F.col("p_name"), 12, WORDS)).alias("term"))


PAIRS_SQL = "list_transform(range(1, greatest(length(t), 2)), lambda i: (unicode(substr(t, i, 1)) * 31 + CASE WHEN length(t) > i THEN unicode(substr(t, i + 1, 1)) ELSE 0 END) % 64)"
VECTOR_SQL = "list_transform(range(64), lambda b: CAST(len(list_filter(p, lambda x: x = b)) AS DOUBLE))"


@query(
    f"""WITH v AS (SELECT k, label, {VECTOR_SQL} AS v FROM (SELECT k, label, {PAIRS_SQL.replace("(t", "(t")} AS p FROM (SELECT p_partkey AS k, p_brand AS label, p_name || ' ' || p_type AS t FROM part))),
a AS (SELECT {VECTOR_SQL} AS v FROM (SELECT {PAIRS_SQL} AS p FROM (SELECT 'red ring of steel' AS t)))
SELECT k, round(greatest(0, least(1, (list_cosine_similarity(v.v, a.v) + 1) / 2)), 6) AS score FROM v, a"""
)
def ext_embedding_score(spark, d):
    anchor = spark.range(1).select(ex.hashed_embedding(F.lit("red ring of steel")).alias("v")).first().v
    rows = load(spark, d, "part").select(F.col("p_partkey").alias("k"), F.lit("Part").alias("label"), F.col("p_name").alias("term"), F.col("p_type").alias("evidence"))
    return ex.embedding_scorer(ex.hashed_embedding, {"Part": anchor})(rows).select("k", F.round("score", 6).alias("score"))


def medical_documents(spark, d):
    """Medical sentences, chosen by key from the vocabularies: as many documents as there are suppliers."""
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("s_suppkey") * n % len(words) + 1).cast("int"))
    disease, symptom, drug, exam, cure = pick(lx.RECALL_DISEASES, 1), pick(lx.RECALL_SYMPTOMS, 3), pick(lx.RECALL_DRUGS, 5), pick(lx.RECALL_EXAMS, 7), pick(lx.RECALL_TREATMENTS, 11)
    section = lambda heading, *content: F.struct(F.lit(heading).alias("heading"), F.concat(*content).alias("content"))
    # the keys are few bytes in one file, the work that they give is for all cores
    keys = load(spark, d, "supplier").select("s_suppkey").repartition(4 * spark.sparkContext.defaultParallelism, "s_suppkey")
    return keys.select(
        F.col("s_suppkey").cast("string").alias("doc_id"),
        disease.alias("title"),
        disease.alias("keyword"),
        F.concat(disease, F.lit("的摘要")).alias("summary"),
        F.array(
            section("症状", F.lit("主要表现为"), symptom, F.lit("、"), pick(lx.RECALL_SYMPTOMS, 13), F.lit("等。")),
            section("药物治疗", F.lit("可用"), drug, F.lit("治疗。必要时手术。")),
            section("检查", F.lit("需做"), exam, F.lit("；以及"), cure, F.lit("。")),
            section("并发症", F.lit("可并发"), pick(lx.RECALL_DISEASES, 17), F.lit("。")),
        ).alias("sections"),
        F.create_map(F.lit("常见症状"), F.concat(pick(lx.RECALL_SYMPTOMS, 19), F.lit("、"), pick(lx.RECALL_SYMPTOMS, 23)), F.lit("治疗方法"), F.concat(pick(lx.RECALL_TREATMENTS, 29), F.lit("，化疗"))).alias("basic_info"),
    )


@query(medical_sql.NODES_SQL)
def ext_medical_nodes(spark, d):
    nodes, _ = ex.extract(medical_documents(spark, d))
    return merge_nodes(nodes, longest=False)


@query(medical_sql.EDGES_SQL)
def ext_medical_edges(spark, d):
    _, edges = ex.extract(medical_documents(spark, d))
    return best_edges(edges)
