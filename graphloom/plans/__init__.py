"""The registered queries of the engine."""

from __future__ import annotations

import importlib

from graphloom.plans.registry import ORACLES, QUERIES, Query

MODULES = ("graph_queries", "document_queries", "extraction_queries", "quality_queries", "medical_queries", "load_queries", "view_queries", "stream_queries")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"graphloom.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
