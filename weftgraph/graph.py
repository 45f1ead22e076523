"""The graph: two tables, and the mutations and lookups on them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .cache import ResultCache
from .errors import EdgeNotFoundError, NodeNotFoundError
from .runtime import stored

_OWN = ("src", "dst", "relation_type", "weight", "ordinal")


def normalised(edges: DataFrame) -> DataFrame:
    """src, dst, relation_type, weight, ordinal and whatever else edges has; edges without both ends go.

    Storage names (from_entity, to_entity, metadata.weight) are understood. Without an ordinal all edges count as added at once.
    """
    has = set(edges.columns)
    src, dst = ("src", "dst") if "src" in has else ("from_entity", "to_entity")
    weight = F.col("weight") if "weight" in has else F.col("metadata.weight") if "metadata" in has else F.lit(1.0)
    rest = [c for c in edges.columns if c not in (*_OWN, "from_entity", "to_entity")]
    return edges.select(
        F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"),
        (F.col("relation_type") if "relation_type" in has else F.lit("relates_to")).alias("relation_type"),
        F.coalesce(weight.cast("double"), F.lit(1.0)).alias("weight"),
        (F.col("ordinal") if "ordinal" in has else F.lit(0)).cast("long").alias("ordinal"), *rest,
    ).where("src is not null and dst is not null")


def last_wins(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst): the one with the highest ordinal; among equals the greatest row, so the result is stable.

    An aggregate, not a window: rows of a pair combine before the shuffle.
    """
    rest = [c for c in edges.columns if c not in ("src", "dst", "ordinal")]
    extra = [c for c in rest if c not in _OWN]
    order = F.struct("ordinal", "relation_type", "weight", *([F.to_json(F.struct(*extra)).alias("extra")] if extra else []))
    kept = edges.groupBy("src", "dst").agg(F.max_by(F.struct("ordinal", *rest), order).alias("e"))
    return kept.select("src", "dst", *[F.col(f"e.{c}").alias(c) for c in edges.columns if c not in ("src", "dst")])


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


class KGraph:
    """A directed graph with one edge for each ordered pair of nodes.

    Tables are immutable; a mutation swaps the references, so transaction() only has to keep the old ones. Nodes are the ends of
    all edges ever added (and, with include_isolated, of a node table): removing an edge leaves its ends.
    """

    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None, include_isolated: bool = False, cache_size: int = 1000, cache_ttl: float = 3600):
        self._edges = last_wins(normalised(edges))
        self.attributes = None if nodes is None else nodes.withColumnRenamed("name", "node") if "name" in nodes.columns else nodes
        extra = self.attributes.select(F.col("node").cast("string").alias("node")) if include_isolated and self.attributes is not None else None
        self._kept = extra
        self._additions = 0
        self._results = ResultCache(cache_size, cache_ttl)

    @classmethod
    def from_edges(cls, edges: DataFrame, **options) -> KGraph:
        return cls(edges, **options)

    @classmethod
    def from_pairs(cls, spark: SparkSession, pairs: Iterable[tuple], **options) -> KGraph:
        """Of tuples (src, dst[, relation_type[, weight]]), in their order."""
        rows = [(p[0], p[1], p[2] if len(p) > 2 else "depends_on", float(p[3]) if len(p) > 3 else 1.0, i) for i, p in enumerate(pairs)]
        return cls(spark.createDataFrame(rows, "src string, dst string, relation_type string, weight double, ordinal long"), **options)

    @property
    def spark(self) -> SparkSession:
        return self._edges.sparkSession

    def edges(self) -> DataFrame:
        return self._edges

    def nodes(self) -> DataFrame:
        """node: each once."""
        found = endpoints(self._edges)
        return found if self._kept is None else found.union(self._kept).distinct()

    def held(self) -> KGraph:
        """Write the edges once for several operators over the same graph; a lost executor costs a re-read only."""
        self._edges = stored(self._edges)
        return self

    def persist(self) -> KGraph:
        """Keep the edges in memory for several operators over the same graph."""
        self._edges = self._edges.persist()
        return self

    def unpersist(self) -> KGraph:
        self._edges.unpersist()
        return self

    # mutations

    def _swap(self, edges: DataFrame, kept: DataFrame | None) -> None:
        self._edges, self._kept = edges, kept
        self._results.clear()

    def add_edges(self, edges: DataFrame) -> None:
        """All or none: what is there already is overwritten."""
        self._additions += 1
        old = self._edges.withColumn("ordinal", F.struct(F.lit(0).alias("batch"), "ordinal"))
        new = normalised(edges).withColumn("ordinal", F.struct(F.lit(1).alias("batch"), "ordinal"))
        both = last_wins(old.unionByName(new, allowMissingColumns=True))
        self._swap(both.withColumn("ordinal", F.col("ordinal.ordinal")), self._kept)

    add_edges_batch = add_edges

    def add_edge(self, src: str, dst: str, relation_type: str = "relates_to", weight: float = 1.0) -> None:
        self.add_edges(self.spark.createDataFrame([(src, dst, relation_type, float(weight))], "src string, dst string, relation_type string, weight double"))

    def remove_edges(self, pairs: DataFrame) -> None:
        """pairs: src, dst. All must be there, and each once, or nothing is removed."""
        pairs = pairs.select("src", "dst")
        twice = pairs.groupBy("src", "dst").count().where("count > 1").drop("count")
        missing = pairs.join(self._edges, ["src", "dst"], "left_anti").unionByName(twice).first()
        if missing:
            raise EdgeNotFoundError(f"No edge exists from '{missing['src']}' to '{missing['dst']}'")
        kept = endpoints(pairs) if self._kept is None else self._kept.union(endpoints(pairs))
        self._swap(self._edges.join(pairs, ["src", "dst"], "left_anti").select(*self._edges.columns), kept)

    remove_edges_batch = remove_edges

    def remove_edge(self, src: str, dst: str) -> None:
        self.remove_edges(self.spark.createDataFrame([(src, dst)], "src string, dst string"))

    @contextmanager
    def transaction(self) -> Iterator[KGraph]:
        """Mutations inside hold together: on an error the graph is as before. May nest."""
        before = self._edges, self._kept
        try:
            yield self
        except BaseException:
            self._swap(*before)
            raise

    # lookups

    def neighbors(self, node: str) -> DataFrame:
        """node: ends of the edges from a node; none for an unknown one."""
        return self._edges.where(F.col("src") == node).select(F.col("dst").alias("node"))

    def edge(self, src: str, dst: str) -> Row | None:
        return self._edges.where((F.col("src") == src) & (F.col("dst") == dst)).first()

    def edge_or_raise(self, src: str, dst: str) -> Row:
        for node, what in ((src, "Source"), (dst, "Target")):
            if not self.has_node(node):
                raise NodeNotFoundError(f"{what} node '{node}' not found in the graph")
        if (found := self.edge(src, dst)) is None:
            raise EdgeNotFoundError(f"No edge exists from '{src}' to '{dst}'")
        return found

    def degrees(self) -> DataFrame:
        """node, degree: the number of edges from each node, 0 included; a self-loop counts once."""
        out = self._edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
        return self.nodes().join(out, "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def degree(self, node: str) -> int:
        return self._edges.where(F.col("src") == node).count()

    def edge_count(self) -> int:
        return self._edges.count()

    def node_count(self) -> int:
        return self.nodes().count()

    def has_node(self, node: str) -> bool:
        at_end = not self._edges.where((F.col("src") == node) | (F.col("dst") == node)).isEmpty()
        return at_end or (self._kept is not None and not self._kept.where(F.col("node") == node).isEmpty())

    def has_edge(self, src: str, dst: str) -> bool:
        return self.edge(src, dst) is not None

    def matching(self, predicate: Column) -> DataFrame:
        return self._edges.where(predicate)

    def find_paths(self, src: str, dst: str, max_depth: int | None = None) -> list[list[str]]:
        """All simple paths as lists of nodes; kept until the next mutation."""
        from .operators.paths import simple_paths

        key = f"{src}\0{dst}\0{max_depth}"
        if (held := self._results.get(key)) is None:
            if src == dst and self.has_node(src):
                held = [[src]]
            else:
                held = sorted(r["nodes"] for r in simple_paths(self, src, dst, max_length=max_depth).collect())
            self._results.put(key, held)
        return held

    def clear_cache(self) -> None:
        self._results.clear()

    def cache_stats(self) -> dict[str, int]:
        return self._results.stats()
