"""Cleaning of nested documents: projection, latest version, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators.merge import latest

DEFAULT_HEADING = "正文"
IMAGES = 12
FAILURES = 20


def clean_sections(sections: F.Column, unescape=None) -> F.Column:
    """Sections with content, text cleaned, a default heading, the first of equal ones kept."""
    tidy = F.transform(sections, lambda s: F.struct(tx.clean_text(s["heading"], unescape).alias("heading"), tx.clean_text(s["content"], unescape).alias("content")))
    named = F.transform(tidy, lambda s: F.struct(F.when(s["heading"] == "", DEFAULT_HEADING).otherwise(s["heading"]).alias("heading"), s["content"].alias("content")))
    return F.array_distinct(F.filter(F.coalesce(named, F.array()), lambda s: s["content"] != ""))


def clean_mapping(entries: F.Column, unescape=None) -> F.Column:
    """Entries with key and value cleaned and without colons at the ends; of keys that meet, the last wins."""
    pairs = F.transform(F.map_entries(entries), lambda e: F.struct(tx.strip(tx.clean_text(e["key"], unescape), ":： ").alias("key"), tx.strip(tx.clean_text(e["value"], unescape), ":： ").alias("value")))
    kept = F.filter(pairs, lambda e: (e["key"] != "") & (e["value"] != ""))
    indexed = F.transform(kept, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i")))
    last = F.filter(indexed, lambda e: ~F.exists(indexed, lambda o: (o["key"] == e["key"]) & (o["i"] > e["i"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))


def clean_images(images: F.Column) -> F.Column:
    return F.array_distinct(F.filter(F.transform(images, lambda x: F.trim(x)), lambda i: i != ""))


def clean_documents(raw: DataFrame, now: F.Column | None = None, unescape=None) -> DataFrame:
    """One cleaned row per raw row; ``now`` is the time of the run, given so that runs can be repeated."""
    c = lambda name: tx.clean_text(F.col(name), unescape)
    row = raw.select(
        F.col("_id").cast("string").alias("raw_id"),
        F.nullif(F.coalesce("doc_id", F.lit("")), F.lit("")).alias("given_id"),
        c("keyword").alias("keyword"),
        c("title").alias("named"),
        c("source").alias("source"),
        F.trim(F.coalesce("source_url", F.lit(""))).alias("source_url"),
        c("summary").alias("summary"),
        clean_mapping(F.col("basic_info"), unescape).alias("basic_info"),
        clean_sections(F.col("sections"), unescape).alias("sections"),
        c("full_text").alias("own_text"),
        clean_images(F.coalesce("images", F.array())).alias("images"),
        F.col("content_source"),
        F.col("content_hash").alias("raw_content_hash"),
        "fetched_at",
        "updated_at",
    )
    row = row.withColumn("title", F.coalesce(F.nullif("named", F.lit("")), "keyword"))
    row = row.withColumn("full_text", F.coalesce(F.nullif(tx.full_text(F.col("summary"), F.col("sections")), F.lit("")), "own_text"))
    by_key = F.when((F.col("source") != "") & (F.col("keyword") != ""), F.sha2(F.concat("source", F.lit("\n"), "keyword").cast("binary"), 256))
    row = row.withColumn("doc_id", F.coalesce("given_id", by_key, "raw_id"))
    canonical = F.concat_ws("\u001f", "keyword", "title", "source", "summary", "full_text", F.to_json(F.array_sort(F.map_entries("basic_info"))), F.to_json("sections"))
    row = row.withColumn("clean_hash", F.sha2(canonical.cast("binary"), 256))
    stats = F.struct(F.size("sections").alias("section_count"), F.length("summary").alias("summary_length"), F.length("full_text").alias("full_text_length"), F.size("images").alias("image_count"))
    return row.withColumn("content_stats", stats).withColumns({"status": F.lit("cleaned"), "cleaned_at": F.current_timestamp() if now is None else now}).drop("named", "own_text", "given_id")


def has_content(summary: F.Column, basic_info: F.Column, sections: F.Column, text: F.Column) -> F.Column:
    return (summary != "") | (F.size(basic_info) > 0) | (F.size(sections) > 0) | (text != "")


def content_check(sections: F.Column, text: F.Column, source: F.Column, least: int = 200) -> F.Column:
    """Sections with content, text length, and whether a page has its full content."""
    filled = F.size(F.filter(sections, lambda s: F.coalesce(s["content"], F.lit("")) != ""))
    size = F.length(F.coalesce(text, F.lit("")))
    return F.struct(((source == "html") & ((filled > 0) | (size >= least))).alias("has_full_content"), filled.alias("section_count"), size.alias("full_text_length"), F.lit(least).alias("min_full_text_length"))


def scan(raw: DataFrame, keyword: str | None = None, limit: int = 0, tie: str = "_id") -> DataFrame:
    """Raw rows of a keyword (all without one), by keyword and newest first, ties by ``tie``; limit 0 means all."""
    rows = raw if not keyword else raw.filter(F.col("keyword") == keyword)
    ordered = rows.orderBy(F.asc("keyword"), F.desc("updated_at"), F.asc(tie))
    return ordered.limit(limit) if limit > 0 else ordered


def scan_cleaned(cleaned: DataFrame, keyword: str | None = None, limit: int = 0) -> DataFrame:
    """Cleaned rows with a document id, of a keyword or title, in the order of ``scan``."""
    rows = cleaned.filter((F.col("status") == "cleaned") & F.col("doc_id").isNotNull())
    if keyword:
        rows = rows.filter((F.col("keyword") == keyword) | (F.col("title") == keyword))
    return scan(rows, None, limit, "doc_id")


def upsert(target: DataFrame, fresh: DataFrame, key: tuple[str, ...], by: str) -> DataFrame:
    """``target`` after ``fresh`` is merged in: the newest row of each key."""
    return latest(target.unionByName(fresh), key, by)


def upsert_cleaned(target: DataFrame, fresh: DataFrame) -> DataFrame:
    """``target`` after cleaned rows are merged in: a row replaces that of its document id, and those without an
    id of its source and keyword.

    Two equi joins, as a join on either key could not be hashed. Of fresh rows of one id the last by
    (updated_at, raw_id) wins.
    """
    newest = fresh.groupBy("doc_id").agg(F.max_by(F.struct(*fresh.columns), F.struct("updated_at", "raw_id")).alias("r")).select("r.*")
    other = newest.filter((F.col("source") != "") & (F.col("keyword") != "")).select("source", "keyword").distinct()
    named = F.coalesce("doc_id", F.lit("")) != ""
    by_id = target.filter(named).join(newest.select("doc_id"), "doc_id", "left_anti").select(*fresh.columns)
    by_name = target.filter(~named).join(other, ["source", "keyword"], "left_anti").select(*fresh.columns)
    return by_id.unionByName(by_name).unionByName(newest.select(*fresh.columns))


def accepted(documents: DataFrame) -> DataFrame:
    """Documents whose content check found their full content."""
    return documents.filter(F.col("content_check.has_full_content"))


def section_chars(sections: F.Column) -> F.Column:
    """Characters of content in all sections."""
    return F.aggregate(sections, F.lit(0).cast("long"), lambda n, s: n + F.length(F.coalesce(s["content"], F.lit(""))))


def report(outcomes: DataFrame, run_id: str, dry_run: bool, source: str, target: str) -> DataFrame:
    """One row for a run over outcomes(raw_id, keyword, outcome, error): counts, and the first failures by raw id."""
    failed = F.when(F.col("outcome") == "failed", F.struct("raw_id", "keyword", "error"))
    counts = outcomes.agg(
        F.count(F.lit(1)).alias("scanned"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("cleaned", "skipped", "failed")],
    )
    # only the first few failures travel, not all of them in one array
    few = outcomes.filter("outcome = 'failed'").orderBy("raw_id").limit(FAILURES).agg(F.array_sort(F.collect_list(failed)).alias("failures"))
    both = counts.crossJoin(F.broadcast(few))  # one row each
    return both.select(F.lit(run_id).alias("run_id"), F.lit("dry_run" if dry_run else "completed").alias("status"), F.lit(source).alias("source_collection"), F.lit(target).alias("target_collection"), F.struct("scanned", "cleaned", "skipped", "failed").alias("stats"), "failures")


def assemble_sections(lines: DataFrame, key: str, pos: str, text: str, is_heading: F.Column, lead: str | None = DEFAULT_HEADING) -> DataFrame:
    """(key, heading, content, number): each heading line opens a section, the lines after it are its content.

    Lines before the first heading go to ``lead``, or are dropped without one. Sections without content are
    dropped. The lines of one document are one window.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("h", is_heading).withColumn("number", F.sum(F.col("h").cast("int")).over(w))
    grouped = marked.groupBy(key, "number").agg(F.max(F.when(F.col("h"), F.col(text))).alias("heading"), F.array_sort(F.collect_list(F.when(~F.col("h"), F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))).alias("body"))
    content = F.array_join(F.transform("body", lambda b: b["t"]), "\n")
    named = F.coalesce("heading", F.lit(lead)) if lead is not None else F.col("heading")
    return grouped.select(key, named.alias("heading"), content.alias("content"), "number").filter((F.col("content") != "") & F.col("heading").isNotNull())


def take_until(lines: DataFrame, key: str, pos: str, is_stop: F.Column) -> DataFrame:
    """Lines before the first stop line of each document."""
    first = lines.filter(is_stop).groupBy(key).agg(F.min(pos).alias("stop_at"))
    return lines.join(first, key, "left").filter(F.col("stop_at").isNull() | (F.col(pos) < F.col("stop_at"))).drop("stop_at")
