"""A table of tools and resources over a store, for a front end that speaks in JSON texts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import QueryError
from .repository import EdgeRepository, NodeRepository
from .sources.store import GraphStore

RESOURCES = {"kg://nodes": "nodes", "kg://edges": "edges"}


class Tools:
    def __init__(self, store: GraphStore):
        self.store = store.initialize()
        self.nodes, self.edges = NodeRepository(store), EdgeRepository(store)
        self.table: dict[str, Callable[..., DataFrame | int]] = {
            "create_nodes": lambda nodes: self._create(self.nodes, nodes),
            "create_edges": lambda edges: self._create(self.edges, edges),
            "update_nodes": lambda nodes: self._change(self.nodes.update, nodes),
            "delete_nodes": lambda nodes: self._change(self.nodes.delete, nodes),
            "get_nodes": lambda **o: self.nodes.list(**o),
            "get_edges": lambda **o: self.edges.list(**o),
        }

    def _create(self, repository, rows: list[dict]) -> int:
        return self._change(repository.create, rows)

    def _change(self, change: Callable[[DataFrame], None], rows: list[dict]) -> int:
        change(self.store.spark.createDataFrame(rows))
        return len(rows)

    def call(self, name: str, arguments: dict | None = None) -> Iterator[str]:
        """The JSON rows of a table, one by one, or how many rows were changed."""
        if name not in self.table:
            raise QueryError(f"Unknown tool: {name}")
        out = self.table[name](**(arguments or {}))
        if isinstance(out, int):
            yield json.dumps({"changed": out})
        else:
            yield from _json(out)

    def read(self, uri: str) -> Iterator[str]:
        if uri not in RESOURCES:
            raise QueryError(f"Unknown resource: {uri}")
        yield from _json(self.store.read(RESOURCES[uri]))


def _json(df: DataFrame) -> Iterator[str]:
    return (r[0] for r in df.select(F.to_json(F.struct("*"))).toLocalIterator())
