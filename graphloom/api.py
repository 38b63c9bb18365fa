"""What a service would call: arguments are checked before a plan is built, results are frames.

A bad argument raises ``ValueError``; an unknown entity gives empty frames.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph, users, view
from graphloom.schema import GraphSchema


def text_of(value: object, name: str) -> str:
    found = str(value or "").strip()
    if not found:
        raise ValueError(f"{name} is missing")
    return found


def whole_number(value: object, default: int) -> int:
    try:
        return int(str(value).strip())
    except ValueError:
        return default


def category_of(value: object, schema: GraphSchema) -> int | None:
    """None for no category; else one of the schema's."""
    if value is None or str(value).strip() == "":
        return None
    number = whole_number(value, -1)
    if not 0 <= number < len(schema.labels):
        raise ValueError(f"category {value!r} is not in 0..{len(schema.labels) - 1}")
    return number


def names_of(value: str | None) -> tuple[str, ...]:
    """Names in a comma-separated list, blank ones left out."""
    return tuple(n for part in (value or "").split(",") if (n := part.strip()))


def ok(data: object) -> dict[str, object]:
    return {"code": 200, "message": "success", "data": data}


def fail(message: str, code: int = 400) -> dict[str, object]:
    return {"code": code, "message": message, "data": None}


def answer(call: Callable[..., object], *args: object, **named: object) -> dict[str, object]:
    """What a service sends back: the result of the call, or why its arguments were refused."""
    try:
        return ok(call(*args, **named))
    except ValueError as e:
        return fail(str(e))


def register_user(users_: DataFrame, username: object, password: object, role: object, preferences: object = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fresh users, preferences, outcome) of one request, to be appended by the caller; see ``register_with_preferences``."""
    if not isinstance(preferences, (list, tuple)):
        raise ValueError("preferences must be an array")
    row = (text_of(username, "username"), text_of(password, "password"), text_of(role, "role"), secrets.token_hex(16), [str(p) for p in preferences])
    request = users_.sparkSession.createDataFrame([row], "username string, password string, role string, salt string, preferences array<string>")
    return users.register_with_preferences(users_, request)


def login_user(users_: DataFrame, preferences: DataFrame, username: object, password: object) -> DataFrame:
    return users.login(users_, preferences, text_of(username, "username"), text_of(password, "password"))


@dataclass(frozen=True)
class Engine:
    """The graph behind a service."""

    vertices: DataFrame
    edges: DataFrame
    schema: GraphSchema

    def suggest(self, keyword: object, category: object = None) -> DataFrame:
        return graph.suggest(self.vertices, self.schema.labels, text_of(keyword, "keyword"), category_of(category, self.schema))

    def neighborhood(self, name: object, depth: object = 1, category: object = None) -> tuple[DataFrame, DataFrame]:
        """(nodes with sizes, relationships) around an entity, to a depth of 1 to 3."""
        entity, wanted = text_of(name, "entity"), category_of(category, self.schema)
        hops = max(1, min(whole_number(depth, 1), graph.MAX_DEPTH))
        if hops == 1:
            rows, column = graph.one_hop(self.vertices, self.edges, self.schema.labels, entity, wanted), "other"
        else:
            rows, column = graph.multi_hop(self.vertices, self.edges, self.schema.labels, entity, hops, wanted), "node"
        return self._shown(rows, entity, column)

    def expand(self, name: object, exclude: str | None = None) -> tuple[DataFrame, DataFrame]:
        """The neighbours that aren't shown yet."""
        entity = text_of(name, "entity")
        return self._shown(graph.one_hop(self.vertices, self.edges, self.schema.labels, entity, exclude=names_of(exclude)), entity, "other")

    def _shown(self, rows: DataFrame, name: str, column: str) -> tuple[DataFrame, DataFrame]:
        rows = graph.small(rows, graph.ROWS_MULTI_HOP + 1)
        nodes = graph.nodes_of(rows, self.vertices, self.schema.labels, name, column)
        edges = graph.edges_of(rows, self.edges)
        sizes = graph.degree_sizes(nodes, edges).select("node_id", "size")
        shown = graph.display_nodes(nodes, self.schema.colors, self.schema.default_color).columns
        sized = nodes.join(sizes, "node_id")
        out = graph.display_nodes(sized.drop("size"), self.schema.colors, self.schema.default_color)
        by_id = sized.select("node_id", "size", F.col("name").alias("id"))
        # a name may stand for several nodes; the largest size is the one that is drawn
        largest = by_id.groupBy("id").agg(F.max("size").alias("size"))
        return out.join(largest, "id").select(*shown, "size").distinct(), graph.display_edges(edges, self.vertices)

    def detail(self, name: object, indications: tuple[str, ...], reactions: tuple[str, ...]) -> DataFrame:
        return graph.entity_detail(self.vertices, self.edges, self.schema.labels, text_of(name, "entity"), indications, reactions)

    def first_view(self, nodes: DataFrame, links: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
        """What a viewer draws first: k diverse nodes and the links among them."""
        chosen = view.diverse_top_k(nodes, k)
        return chosen, view.links_both(links, chosen)

    def feed(self, preferences: DataFrame, username: object) -> DataFrame:
        return users.feed(users.first_preferences(preferences.filter(F.col("username") == text_of(username, "username"))))
