"""Graph schema as data, and the row types that pass between the stages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class GraphSchema:
    """Labels in order of category, and relation types with the labels of their ends."""

    labels: tuple[str, ...]
    relations: dict[str, tuple[str, str]]
    colors: dict[str, str] = field(default_factory=dict)
    default_color: str = "#999999"


# Labels and relation types of the medical graph.
MEDICAL = GraphSchema(
    ("Disease", "Symptom", "Drug", "Examination", "Treatment"),
    {
        "HAS_SYMPTOM": ("Disease", "Symptom"),
        "REQUIRES_EXAM": ("Disease", "Examination"),
        "TREATS_DISEASE": ("Drug", "Disease"),
        "TREATED_BY": ("Disease", "Treatment"),
        "HAS_COMPLICATION": ("Disease", "Disease"),
    },
)

#: The same shape on the trade tables.
TRADE = GraphSchema(
    ("Region", "Nation", "Customer", "Supplier", "Part"),
    {
        "IN_REGION": ("Nation", "Region"),
        "LIVES_IN": ("Customer", "Nation"),
        "BASED_IN": ("Supplier", "Nation"),
        "SUPPLIES": ("Supplier", "Part"),
        "BOUGHT": ("Customer", "Part"),
    },
    {"Region": "#c0392b", "Nation": "#e67e22", "Customer": "#2980b9", "Supplier": "#27ae60", "Part": "#8e44ad"},
)

SECTION = T.StructType([T.StructField("heading", T.StringType()), T.StructField("content", T.StringType())])
RAW_DOCUMENT = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("basic_info", T.MapType(T.StringType(), T.StringType())),
        T.StructField("sections", T.ArrayType(SECTION)),
        T.StructField("full_text", T.StringType()),
        T.StructField("images", T.ArrayType(T.StringType())),
        T.StructField("content_source", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
# Columns of the graph files (header name in the file, name in the engine) and of rejected rows.
NODE_COLUMNS = {"node_id:ID": "node_id", "name": "name", "type:LABEL": "label", "source_doc_ids": "source_doc_ids", "description": "description"}
EDGE_COLUMNS = {
    ":START_ID": "src",
    ":END_ID": "dst",
    ":TYPE": "rel_type",
    "source_doc_id": "source_doc_id",
    "evidence": "evidence",
    "confidence:float": "confidence",
    "section": "section",
}
REJECT_COLUMNS = ("item_type", "reason", "id", "name", "type", "start_id", "end_id", "relationship_type", "confidence", "evidence", "source_doc_id")
