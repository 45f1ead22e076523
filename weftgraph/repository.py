"""Validated create, read, update and delete over a store's tables, in bulk: a table of rows in, one commit out."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .cache import ResultCache
from .errors import ConflictError, DuplicateResourceError, EdgeNotFoundError, NodeNotFoundError, ResourceNotFoundError, ValidationError
from .graph import KGraph
from .operators import paths, subgraphs
from .operators.components import weak_components
from .operators.traversal import expand
from .schema import EDGE_KEY, NODE_KEY, with_edge_defaults, with_node_defaults
from .search.filters import equal_fields
from .sources.store import Change, TableStore
from .validation import edge_errors, node_errors

#: How often a change is tried while other writers are faster.
ATTEMPTS = 5
Validator = Callable[[DataFrame], Column]


def paginate(df: DataFrame, key: list[str], limit: int | None = None, offset: int = 0) -> DataFrame:
    """In the order of the key; all rows without a limit."""
    if offset < 0 or (limit is not None and limit < 1):
        raise ValidationError("offset must not be negative and limit must be positive")
    if limit is None and not offset:
        return df
    out = df.orderBy(*key)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def with_dependencies(nodes: DataFrame, root: str, transitive: bool = True) -> DataFrame:
    """The node and those it depends on, directly or through others; names that are no node are skipped."""
    found = nodes.where(F.col("name") == root)
    if found.isEmpty():
        raise NodeNotFoundError(f"Node '{root}' not found")
    links = nodes.select(F.col("name").alias("src"), F.explode("dependencies").alias("dst"))
    have = links.join(nodes.select(F.col("name").alias("dst")), "dst", "left_semi")
    reached = expand(have, found.select(F.col("name").alias("node")), None if transitive else 1).select(F.col("node").alias("name"))
    return nodes.join(reached, "name", "left_semi")


class Repository:
    table, key, missing = "", [], ResourceNotFoundError

    def __init__(self, store: TableStore, validators: Iterable[Validator] = (), cache: ResultCache | None = None):
        """validators: functions from the table to a Column that is true for valid rows."""
        self.store, self.validators, self.cache = store, list(validators), cache

    def errors(self) -> Column:
        raise NotImplementedError

    def defaults(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    @property
    def rows(self) -> DataFrame:
        return self.store.read(self.table)

    def validate(self, df: DataFrame) -> DataFrame:
        """df with the array column errors: built-in checks, then the validators."""
        own = [F.when(~F.coalesce(v(df), F.lit(False)), F.lit(f"validator {i} failed")) for i, v in enumerate(self.validators)]
        more = F.filter(F.array(*own), lambda x: x.isNotNull()) if own else F.array().cast("array<string>")
        return df.withColumn("errors", F.concat(self.errors(), more))

    def _checked(self, df: DataFrame) -> DataFrame:
        df = self.defaults(df)
        if bad := self.validate(df).where(F.size("errors") > 0).select(*self.key, "errors").first():
            raise ValidationError(f"{':'.join(str(bad[k]) for k in self.key)}: {'; '.join(bad['errors'])}")
        return df

    def _changed(self, make: Callable[[], dict[str, Change]]) -> None:
        """Commit what make() finds to do; again from the start if another writer was faster."""
        for attempt in range(ATTEMPTS):
            began = self.store.version()
            try:
                self.store.commit(make(), began)
                break
            except ConflictError:
                if attempt == ATTEMPTS - 1:
                    raise
        if self.cache:
            self.cache.clear()

    def _touched(self, df: DataFrame, created: bool) -> DataFrame:
        meta = F.col("metadata").withField("last_modified", F.localtimestamp())
        return df.withColumn("metadata", meta.withField("created_at", F.localtimestamp()) if created else meta)

    def create(self, df: DataFrame) -> None:
        """All rows, or none if one is invalid, there already, or given twice."""
        df = self._touched(self._checked(df), created=True)

        def make() -> dict[str, Change]:
            again = df.groupBy(*self.key).count().where("count > 1").select(*self.key)
            if clash := df.select(*self.key).join(self.rows, self.key, "left_semi").unionByName(again).first():
                raise DuplicateResourceError(f"{self.table[:-1]} already exists: {':'.join(map(str, clash))}")
            return {self.table: Change(rows=df)}

        self._changed(make)

    def get(self, *key: str) -> Row:
        name = f"{type(self).__name__}:{key!r}"
        if self.cache and (held := self.cache.get(name)) is not None:
            return held
        found = self.rows.where(self._is(key)).first()
        if found is None:
            raise self.missing(f"{self.table[:-1].capitalize()} not found: {':'.join(key)}")
        if self.cache:
            self.cache.put(name, found)
        return found

    def _is(self, key: tuple[str, ...]) -> Column:
        out = F.lit(True)
        for k, v in zip(self.key, key, strict=True):
            out = out & (F.col(k) == v)
        return out

    def exists(self, *key: str) -> bool:
        return not self.rows.where(self._is(key)).isEmpty()

    def get_or_create(self, df: DataFrame) -> DataFrame:
        """The stored rows of df's keys, after those that are not there were created."""
        new = self.defaults(df).join(self.rows, self.key, "left_anti")
        if not new.isEmpty():
            self.create(new)
        return self.rows.join(self.defaults(df).select(*self.key), self.key, "left_semi")

    def _all_there(self, keys: DataFrame) -> None:
        if gone := keys.join(self.rows, self.key, "left_anti").first():
            raise self.missing(f"{self.table[:-1].capitalize()} not found: {':'.join(map(str, gone))}")

    def update(self, df: DataFrame) -> None:
        """Replace the rows of the same keys, which must be there; other rows are not written."""
        df = self._touched(self._checked(df), created=False)

        def make() -> dict[str, Change]:
            keys = df.select(*self.key)
            self._all_there(keys)
            return {self.table: Change(rows=df, gone=keys)}

        self._changed(make)

    def delete(self, keys: DataFrame) -> None:
        self._delete(keys)

    def _delete(self, keys: DataFrame, more: Callable[[DataFrame], dict[str, Change]] | None = None) -> None:
        """more: what else goes in the same commit."""
        keys = keys.select(*self.key).distinct()

        def make() -> dict[str, Change]:
            self._all_there(keys)
            return {self.table: Change(gone=keys), **(more(keys) if more else {})}

        self._changed(make)

    def list(self, filters: dict[str, Any] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        rows = self.rows
        return paginate(rows.where(equal_fields(rows, filters)) if filters else rows, self.key, limit, offset)


class NodeRepository(Repository):
    table, key, missing = "nodes", NODE_KEY, NodeNotFoundError

    def errors(self) -> Column:
        return node_errors()

    def defaults(self, df: DataFrame) -> DataFrame:
        return with_node_defaults(df)

    def by_type(self, entity_type: str, limit: int | None = None) -> DataFrame:
        return paginate(self.rows.where(F.col("entity_type") == entity_type), self.key, limit)

    def with_dependencies(self, name: str, transitive: bool = False) -> DataFrame:
        return with_dependencies(self.rows, name, transitive)

    def delete(self, keys: DataFrame, cascade: bool = True) -> None:
        """With cascade, edges of the nodes go too, in the same commit."""
        self._delete(keys, self._edges_of if cascade else None)

    def _edges_of(self, keys: DataFrame) -> dict[str, Change]:
        edges = self.store.read("edges")
        ends = [edges.join(keys.select(F.col("name").alias(end)), end, "left_semi").select(*EDGE_KEY) for end in ("from_entity", "to_entity")]
        return {"edges": Change(gone=ends[0].union(ends[1]).distinct())}


class EdgeRepository(Repository):
    table, key, missing = "edges", EDGE_KEY, EdgeNotFoundError

    def errors(self) -> Column:
        return edge_errors()

    def defaults(self, df: DataFrame) -> DataFrame:
        return with_edge_defaults(df)

    def graph(self) -> KGraph:
        return KGraph(self.rows)

    def by_type(self, relation_type: str, limit: int | None = None) -> DataFrame:
        return paginate(self.rows.where(F.col("relation_type") == relation_type), self.key, limit)

    def of_node(self, node: str, direction: str = "both") -> DataFrame:
        """incoming, outgoing, or any other word for both; a self-loop once."""
        out, into = F.col("from_entity") == node, F.col("to_entity") == node
        return self.rows.where(out if direction == "outgoing" else into if direction == "incoming" else out | into)

    def find_paths(self, src: str, dst: str, max_depth: int = 3) -> DataFrame:
        return paths.all_paths(self.graph(), src, dst, max_length=max_depth)

    def connected_components(self) -> DataFrame:
        return weak_components(self.graph())

    def neighborhood(self, node: str, radius: int = 1) -> DataFrame:
        return subgraphs.neighborhood(self.graph(), node, radius)[1]
