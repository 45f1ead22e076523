"""Subgraphs: neighbourhoods and selections by type."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import KGraph
from ..runtime import one_row
from ..schema import value_of
from .traversal import Predicate, as_predicate, bfs


def edge_key(directed: bool = True) -> Column:
    """What tells edges apart: (src, dst, relation_type), or the two ends in order."""
    return F.struct("src", "dst", "relation_type") if directed else F.struct(F.least("src", "dst"), F.greatest("src", "dst"))


def induced(edges: DataFrame, nodes: DataFrame, where: Column | None = None) -> DataFrame:
    """Edges with both ends in nodes that meet the condition."""
    inside = nodes.select("node").distinct()
    found = edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return found if where is None else found.where(where)


def neighborhood(graph: KGraph, center: str, radius: int = 1, nodes_where: Predicate = None, edges_where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes within radius of center that meet nodes_where, and the edges among them.

    The walk itself ignores nodes_where. Radius 0, and a center that fails nodes_where, give the center and no edges.
    """
    one = one_row(graph.spark, node=center)
    p = as_predicate(nodes_where)
    if radius == 0 or (p is not None and one.where(p).isEmpty()):
        return one, graph.edges().where("false")
    found = bfs(graph, center, radius).select("node")
    found = found if p is None else found.where(p)
    return found, induced(graph.edges(), found, edges_where)


def by_type(graph: KGraph, nodes: DataFrame, entity_types: Iterable[str] | None = None, relation_types: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of these types, given as names (CODE_MODULE) or values; None or nothing selects all.

    With entity types both ends of an edge must have one of them in nodes (name or node, entity_type).
    """
    typed = nodes.select(F.col("name" if "name" in nodes.columns else "node").alias("node"), "entity_type")
    edges = graph.edges()
    if wanted := [value_of(r) if r.isupper() else r for r in relation_types or ()]:
        edges = edges.where(F.col("relation_type").isin(wanted))
    if kinds := [value_of(t) if t.isupper() else t for t in entity_types or ()]:
        inside = typed.where(F.col("entity_type").isin(kinds)).select("node")
        return graph.nodes().join(inside, "node", "left_semi"), induced(edges, inside)
    return graph.nodes(), edges


def with_end_types(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with src_type and dst_type from nodes; null for an end that is not in nodes."""
    typed = nodes.select(F.col("name" if "name" in nodes.columns else "node").alias("node"), "entity_type")
    return edges.join(typed.toDF("src", "src_type"), "src", "left").join(typed.toDF("dst", "dst_type"), "dst", "left")
