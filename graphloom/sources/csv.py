"""Graph files: CSV with a header, all strings, quotes doubled, blank cells as empty texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.quality import Outputs
from graphloom.schema import EDGE_COLUMNS, NODE_COLUMNS, REJECT_COLUMNS

OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8", "emptyValue": "", "nullValue": "\u0000"}


def read(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """The file with the engine's column names. A byte order mark before the first header is dropped."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    frame = spark.read.options(**OPTIONS, enforceSchema=True).schema(schema).csv(path)
    return frame.select(*[F.coalesce(F.col(f"`{name}`"), F.lit("")).alias(own) for name, own in columns.items()])


def write(frame: DataFrame, path: str, columns: dict[str, str], order: tuple[str, ...], single: bool = False) -> None:
    """Rows in order; one file only where asked for, since that leaves the whole sort to one task."""
    out = frame.orderBy(*order)
    if single:
        out = out.coalesce(1)
    options = {k: v for k, v in OPTIONS.items() if k not in ("multiLine", "nullValue")}
    out.select(*[F.col(own).cast("string").alias(name) for name, own in columns.items()]).write.mode("overwrite").options(**options).csv(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, single: bool = False) -> None:
    """nodes(node_id, name, label, docs, description) and edges, in the files' form and order."""
    flat = nodes.withColumn("source_doc_ids", F.concat_ws(";", F.array_sort("docs")))
    write(flat, f"{path}/nodes", NODE_COLUMNS, ("label", "name"), single)
    write(edges.withColumn("confidence", F.format_string("%.2f", "confidence")), f"{path}/relationships", EDGE_COLUMNS, ("rel_type", "source_doc_id", "src", "dst"), single)


def write_outputs(out: Outputs, path: str, single: bool = False) -> None:
    """The four files of the quality stage; edges in the order of their type, ends and document."""
    nodes = out.nodes.withColumn("source_doc_ids", F.concat_ws(";", F.array_sort("docs")))
    edges = out.edges.withColumn("confidence", F.format_string("%.2f", "confidence"))
    write(nodes, f"{path}/nodes", NODE_COLUMNS, ("label", "name"), single)
    write(edges, f"{path}/relationships", EDGE_COLUMNS, ("rel_type", "src", "dst", "source_doc_id"), single)
    write(out.rejects, f"{path}/rejects", {c: c for c in REJECT_COLUMNS}, ("item_type", "reason", "id", "start_id", "end_id"), single)
    write(out.summary, f"{path}/summary", {"metric": "metric", "value": "value"}, ("metric",), single)
