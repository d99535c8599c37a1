"""Graph patterns over node and edge tables.

``nodes`` has ``id``, ``labels`` (array of string) and ``properties`` (struct or map); ``edges`` has
``id``, ``src``, ``dst``, ``typ`` and ``properties``. In conditions and outputs a node is named by
its alias, so ``a.properties.name`` is a property of node ``a``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import extract
from ..functions.jsontext import edge_to_json, node_to_json, node_value, path_to_json, unbound_edge_value
from ..functions.types import spark_type
from .ranking import take_ordered


def _labelled(nodes: DataFrame, label: str | None) -> DataFrame:
    return nodes if label is None else nodes.where(F.array_contains("labels", label))


def _packed(df: DataFrame, alias: str) -> DataFrame:
    """The whole row as one struct column; unused fields are pruned from the scan."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(alias))


def _finish(
    rows: DataFrame,
    where: str | Column | None,
    returning: Mapping[str, str | Column],
    order_by: Sequence[str],
    limit: int | None,
) -> DataFrame:
    """WHERE, RETURN, ORDER BY and LIMIT of a pattern."""
    if where is not None:
        rows = rows.where(where)
    out = rows.select(*[(F.expr(e) if isinstance(e, str) else e).alias(name) for name, e in returning.items()])
    keys = [F.col(name[1:]).desc() if name.startswith("-") else F.col(name).asc() for name in order_by]
    if limit is not None:
        return take_ordered(out, keys, limit) if keys else out.limit(limit)
    return out.orderBy(*keys) if keys else out


def match_nodes(
    nodes: DataFrame,
    label: str | None,
    returning: Mapping[str, str | Column],
    where: str | Column | None = None,
    order_by: Sequence[str] = (),
    limit: int | None = None,
    alias: str = "n",
) -> DataFrame:
    """``(n:Label)`` with a filter and output expressions; ``-name`` in ``order_by`` is descending."""
    return _finish(_packed(_labelled(nodes, label), alias), where, returning, order_by, limit)


@dataclass(frozen=True)
class Hop:
    """``-[:typ]->(:label)``, one step of a path; ``incoming`` follows the edge backwards."""

    typ: str | None
    label: str | None = None
    incoming: bool = False


def _steps(nodes: DataFrame, edges: DataFrame, start: str | None, hops: Sequence[Hop]) -> DataFrame:
    """Columns ``n0, e1, n1, e2, ...``: per hop one join with the edges and one with the nodes.

    Node ids are unique, so a hot node is a hot key on the edge side only, which adaptive execution
    splits.
    """
    rows = _packed(_labelled(nodes, start), "n0")
    for i, hop in enumerate(hops, 1):
        typed = edges if hop.typ is None else edges.where(F.col("typ") == hop.typ)
        near, far = ("dst", "src") if hop.incoming else ("src", "dst")
        edge = _packed(typed, f"e{i}")
        node = _packed(_labelled(nodes, hop.label), f"n{i}")
        rows = rows.join(edge, F.col(f"n{i - 1}.id") == F.col(f"e{i}.{near}"))
        rows = rows.join(node, F.col(f"e{i}.{far}") == F.col(f"n{i}.id"))
    return rows


def match_edge(
    nodes: DataFrame,
    edges: DataFrame,
    typ: str | None,
    returning: Mapping[str, str | Column],
    start_label: str | None = None,
    end_label: str | None = None,
    where: str | Column | None = None,
    order_by: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """``(a:Start)-[r:TYPE]->(b:End)``, one hop; the aliases are ``a``, ``r`` and ``b``."""
    rows = _steps(nodes, edges, start_label, [Hop(typ, end_label)])
    return _finish(
        rows.withColumnsRenamed({"n0": "a", "e1": "r", "n1": "b"}), where, returning, order_by, limit
    )


def match_path(
    nodes: DataFrame,
    edges: DataFrame,
    start_label: str | None,
    hops: Sequence[Hop],
    returning: Mapping[str, str | Column],
    where: str | Column | None = None,
    order_by: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """A path with a fixed number of hops; nodes are ``n0, n1, ..``, edges ``e1, e2, ..``."""
    return _finish(_steps(nodes, edges, start_label, hops), where, returning, order_by, limit)


def _properties_type(df: DataFrame) -> T.DataType:
    return df.schema["properties"].dataType


def node_json(nodes: DataFrame, alias: str = "n") -> Column:
    """The node named ``alias`` as JSON text."""
    return node_to_json(*_node_parts(alias), _properties_type(nodes))


def _node_parts(alias: str) -> tuple[Column, Column, Column]:
    return F.col(f"{alias}.id"), F.col(f"{alias}.labels"), F.col(f"{alias}.properties")


def edge_json(edges: DataFrame, alias: str = "r", unbound: bool = False) -> Column:
    """The edge named ``alias`` as JSON text, with or without its ends."""
    ends = None if unbound else (F.col(f"{alias}.src"), F.col(f"{alias}.dst"))
    return edge_to_json(
        F.col(f"{alias}.id"), F.col(f"{alias}.typ"), F.col(f"{alias}.properties"), _properties_type(edges), ends
    )


def path_json(nodes: DataFrame, edges: DataFrame, hops: int) -> Column:
    """The matched path as JSON text: its nodes, and its edges without their ends."""
    node_type, edge_type = _properties_type(nodes), _properties_type(edges)
    node_values = [node_value(*_node_parts(f"n{i}"), node_type) for i in range(hops + 1)]
    edge_values = [
        unbound_edge_value(F.col(f"e{i}.id"), F.col(f"e{i}.typ"), F.col(f"e{i}.properties"), edge_type)
        for i in range(1, hops + 1)
    ]
    return path_to_json(node_values, edge_values)


# -- rows of untyped values ---------------------------------------------------------------------

# JSON kind of a value in the first row -> graph value kind of its column.
FIRST_ROW_KINDS = {"BOOLEAN": "Boolean", "BIGINT": "Integer", "DECIMAL": "Float", "DOUBLE": "Float"}


def first_row_types(df: DataFrame, doc: str, position: str) -> list[tuple[str, str]]:
    """Column names and Spark types from the first row alone; no row gives no column."""
    first = df.agg(F.min_by(doc, position).alias(doc), F.json_object_keys(F.min_by(doc, position)).alias("keys")).first()
    if not first["keys"]:
        return []
    names = sorted(first["keys"])
    row = extract.parsed(df.sparkSession.createDataFrame([(first[doc],)], f"`{doc}` string"), doc)
    kinds = row.select(*[extract.json_kind(extract.value_at(F.col(extract.PARSED), [n])) for n in names]).first()
    found = [FIRST_ROW_KINDS.get((kind or "").split("(")[0], "") for kind in kinds]
    return [(name, spark_type("neo4j", kind)) for name, kind in zip(names, found)]


def first_row_schema(df: DataFrame, doc: str, position: str) -> DataFrame:
    """JSON rows as columns typed by the first row; NULL there means string.

    A later value of another kind is NULL in a typed column and JSON text in a string column.
    """
    types = first_row_types(df, doc, position)
    if not types:
        return df.select()
    return extract.extract_typed(df, doc, [([name], target) for name, target in types], [position], strict=True)
