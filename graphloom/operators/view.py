"""Selections that a viewer of a graph makes: diverse top-k, links among nodes, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diverse_top_k(nodes: DataFrame, k: int, category: str = "category", size: str = "size", pos: str = "pos") -> DataFrame:
    """Up to k nodes: the largest of each category in turn. Only k per category can be chosen, so no more are ranked on."""
    w = Window.partitionBy(category).orderBy(F.desc(size), F.asc(pos))
    ranked = nodes.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= k)
    return ranked.orderBy("turn", category).limit(k)


def links_both(links: DataFrame, nodes: DataFrame, name: str = "name") -> DataFrame:
    """Links with both ends (source, target) among the nodes."""
    ids = nodes.select(name).distinct()
    return links.join(ids.withColumnRenamed(name, "source"), "source", "left_semi").join(ids.withColumnRenamed(name, "target"), "target", "left_semi")


def links_either(links: DataFrame, nodes: DataFrame, name: str = "name", key: str = "link_id") -> DataFrame:
    """Links with an end among the nodes, as two equi joins rather than one on either condition."""
    ids = nodes.select(name).distinct()
    first = links.join(ids.withColumnRenamed(name, "source"), "source", "left_semi").select(*links.columns)
    second = links.join(ids.withColumnRenamed(name, "target"), "target", "left_semi").select(*links.columns)
    return first.unionByName(second).dropDuplicates([key])


def trim(nodes: DataFrame, links: DataFrame, parent: str, clicked: str) -> DataFrame:
    """The parent, the clicked node and the clicked node's neighbours."""
    ends = links.filter((F.col("source") == clicked) | (F.col("target") == clicked))
    near = ends.select(F.when(F.col("source") == clicked, F.col("target")).otherwise(F.col("source")).alias("name"))
    return nodes.join(near.distinct(), "name", "left_semi").unionByName(nodes.filter(F.col("name").isin(parent, clicked))).dropDuplicates(["name"])


def drawn_nodes(nodes: DataFrame, categories_: dict[str, int], size: int = 30) -> DataFrame:
    """Nodes(id, node_type, size, description, color) as a viewer draws them: an unknown type is category 0, no size is ``size``."""
    known = F.create_map(*[F.lit(x) for pair in categories_.items() for x in pair])
    drawn = F.when(F.coalesce("size", F.lit(0)) == 0, size).otherwise(F.col("size"))
    return nodes.select(F.col("id").alias("name"), F.coalesce(known[F.coalesce("node_type", F.lit(""))], F.lit(0)).alias("category"), drawn.alias("symbol_size"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("node_type", F.lit("")).alias("node_type"), F.nullif("color", F.lit("")).alias("color"))


def drawn_links(edges: DataFrame) -> DataFrame:
    """Relationships(from, to, caption, type) as links with the text they show."""
    shown = F.coalesce(F.nullif("caption", F.lit("")), "type", F.lit(""))
    return edges.select(F.col("from").alias("source"), F.col("to").alias("target"), shown.alias("label"))


def local_suggestions(names: DataFrame, nodes: DataFrame, keyword: str, category: int | None = None, limit: int = 10) -> DataFrame:
    """Names that contain the keyword, with the category that ``nodes`` give them, in the names' order (``pos``).

    A name that stands for several nodes has the category of the last (``pos``).
    """
    found = names.filter(F.contains("name", F.lit(keyword)))
    if category is not None:
        of = nodes.groupBy("name").agg(F.max_by("category", "pos").alias("category"))
        found = found.join(of.filter(F.col("category") == category).select("name"), "name", "left_semi")
    return found.orderBy("pos").limit(limit).select("name")


def or_fallback(found: DataFrame, fallback: DataFrame) -> DataFrame:
    """``found``, or ``fallback`` where it is empty."""
    empty = found.limit(1).agg((F.count(F.lit(1)) == 0).alias("empty"))
    stand_in = fallback.select(*found.columns).crossJoin(F.broadcast(empty)).filter("empty").drop("empty")  # one row
    return found.unionByName(stand_in)


def merged_links(shown: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Links on view and fresh ones that aren't among them, each once."""
    added = fresh.dropDuplicates(key).join(shown.select(*key), key, "left_anti").select(*shown.columns)
    return shown.unionByName(added)


def new_nodes(fresh: DataFrame, shown: DataFrame) -> DataFrame:
    return fresh.join(shown.select("name"), "name", "left_anti")


def captions(links: DataFrame, names: dict[str, str]) -> DataFrame:
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return links.withColumn("shown", F.coalesce(known[F.col("caption")], F.col("caption"), F.lit("")))


def categories(nodes: DataFrame, names: tuple[str, ...], least: int = 8) -> DataFrame:
    """(category, name) from 0 to the greatest category, at least ``least`` of them; unnamed ones by number."""
    top = nodes.agg(F.greatest(F.coalesce(F.max("category") + 1, F.lit(0)), F.lit(least)).alias("n"))
    known = F.array(*[F.lit(n) for n in names])
    return top.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("category")).select("category", F.coalesce(F.get(known, F.col("category")), F.concat(F.lit("category "), F.col("category").cast("string"))).alias("name"))


def history(events: DataFrame, user: str, ts: str, key: list[str], limit: int = 10) -> DataFrame:
    """Per user the last ``limit`` distinct keys, newest first."""
    last = events.groupBy(user, *key).agg(F.max(ts).alias("last_at"))
    w = Window.partitionBy(user).orderBy(F.desc("last_at"), *key)
    return last.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def previous(events: DataFrame, user: str, ts: str, tie: str, value: str) -> DataFrame:
    w = Window.partitionBy(user).orderBy(ts, tie)
    return events.withColumn("previous", F.lag(value).over(w))
