"""Shortest and simple paths."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GraphOperationError, PathValidationError
from ..graph import KGraph
from ..runtime import checkpointed, counted, dealt_by, one_row
from .traversal import require

MAX_LENGTH, MAX_PATHS = 50, 1000
SHORTEST, ALL, FILTERED = "shortest", "all", "filtered"
_EDGE = "array<struct<src:string,dst:string,relation_type:string,weight:double>>"


@dataclass
class PathResult:
    edges: list = field(default_factory=list)
    total_weight: float = 0.0
    length: int = 0

    @property
    def nodes(self) -> list[str]:
        return [self.edges[0]["src"], *(e["dst"] for e in self.edges)] if self.edges else []

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, i):
        return self.edges[i]

    def __iter__(self):
        return iter(self.edges)

    def validate(self) -> None:
        for i, (a, b) in enumerate(zip(self.edges, self.edges[1:], strict=False)):
            if a["dst"] != b["src"]:
                raise PathValidationError(f"edge {i} ends in {a['dst']}, but edge {i + 1} begins in {b['src']}")
        if len(self.edges) != self.length:
            raise PathValidationError(f"{len(self.edges)} edges in a path of length {self.length}")


def path_errors(edges: Column, length: Column) -> Column:
    """For a column of paths: null if the edges join and are as many as length, else what is wrong."""
    joins = F.forall(F.sequence(F.lit(0), F.size(edges) - 2), lambda i: F.get(edges, i)["dst"] == F.get(edges, i + 1)["src"])
    return F.when((F.size(edges) > 1) & ~joins, "edges do not join").when(F.size(edges) != length, "not as many edges as its length")


def _weighted(graph: KGraph, weight: Column | None) -> DataFrame:
    """The edges with the weight in use; a weight that is not positive is an error."""
    edges = graph.edges().select("src", "dst", "relation_type", (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"))
    if weight is not None and (bad := edges.where("not (weight > 0) or weight is null").first()):
        raise ValueError(f"the weight {bad['weight']} of {bad['src']} -> {bad['dst']} is not positive")
    return edges


def distances(edges: DataFrame, source: str, target: str | None = None) -> DataFrame:
    """node, distance by relaxation over the nodes that improved last, one job a round; with a target, until none nearer than it
    is left."""
    known = front = one_row(edges.sparkSession, node=source, distance=0.0, moved=True)
    of_target = F.min(F.when(F.col("node") == target, F.col("distance")) if target is not None else F.lit(None).cast("double")).alias("limit")
    limit = None
    with dealt_by(edges.select(F.col("src").alias("node"), "dst", "weight"), "node") as steps:
        while True:
            step = front.join(steps, "node").groupBy(F.col("dst").alias("node")).agg(F.min(F.col("distance") + F.col("weight")).alias("new"))
            if limit is not None:
                step = step.where(F.col("new") < limit)
            better = F.col("new").isNotNull() & (F.col("distance").isNull() | (F.col("new") < F.col("distance")))
            joined = known.drop("moved").join(step, "node", "full_outer").select("node", F.when(better, F.col("new")).otherwise(F.col("distance")).alias("distance"), F.coalesce(better, F.lit(False)).alias("moved"))
            known, now = counted(joined, F.count_if("moved").alias("moved"), of_target)
            if not now["moved"]:
                return known.select("node", "distance")
            limit, front = now["limit"], known.where("moved").drop("moved")


def chain(before: DataFrame, target: str) -> list[str]:
    """The nodes from the one without a predecessor to target, by before (node, before: one row each). Jumps double, so the jobs
    grow with the logarithm of the path's length; the driver sees the path alone."""
    jumps = [checkpointed(before.select("node", F.col("before").alias("to")))]
    found = one_row(before.sparkSession, node=target, back=0)
    while True:
        last = jumps[-1]
        hop = last.select(F.col("node").alias("to"), F.col("to").alias("end"))
        found = found.union(found.join(last, "node").select(F.col("to").alias("node"), (F.col("back") + 2 ** (len(jumps) - 1)).alias("back")))
        longer, now = counted(last.join(hop, "to").select("node", F.col("end").alias("to")))
        jumps.append(longer)
        if longer.where(F.col("node") == target).isEmpty():
            break
    return [r["node"] for r in found.orderBy(F.desc("back")).collect()]


def predecessors(edges: DataFrame, dist: DataFrame, source: str) -> DataFrame:
    """node, before: on a shortest path, the least (distance, name) that leads to the node."""
    u = dist.select(F.col("node").alias("src"), F.col("distance").alias("du"))
    v = dist.select(F.col("node").alias("dst"), F.col("distance").alias("dv"))
    on = edges.join(u, "src").join(v, "dst").where((F.col("du") + F.col("weight") == F.col("dv")) & (F.col("dst") != source))
    return on.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("du", "src")).alias("p")).select("node", F.col("p.src").alias("before"))


def shortest_path(graph: KGraph, source: str, target: str, weight: Column | None = None) -> PathResult:
    """The shortest path (each edge 1, or the column weight); ties go to the nearer, then lesser predecessor."""
    require(graph, source, "Start")
    require(graph, target, "End")
    if source == target:
        return PathResult()
    edges = _weighted(graph, weight)
    dist = checkpointed(distances(edges, source, target))
    total = dist.where(F.col("node") == target).first()
    if total is None:
        raise GraphOperationError(f"No path exists between {source} and {target}")
    nodes = chain(predecessors(edges, dist, source), target)
    at = {(r["src"], r["dst"]): r for r in edges.where(F.struct("src", "dst").isin([F.struct(F.lit(a), F.lit(b)) for a, b in zip(nodes, nodes[1:], strict=False)])).collect()}
    found = [at[pair].asDict() for pair in zip(nodes, nodes[1:], strict=False)]
    return PathResult(found, total["distance"], len(found))


def _live_edges(graph: KGraph, source: str, target: str, max_length: int | None, weight: Column | None) -> DataFrame:
    """at, dst, weight, b (edges from dst to the target at least), edge: the edges on some walk from source to target within
    max_length."""
    from .traversal import expand

    edges = _weighted(graph, weight)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seed = lambda n: one_row(graph.spark, node=n)
    ahead = expand(edges, seed(source), max_length).select(F.col("node").alias("src"), F.col("depth").alias("a"))
    behind = expand(back, seed(target), max_length).select(F.col("node").alias("dst"), F.col("depth").alias("b"))
    live = edges.join(ahead, "src").join(behind, "dst").where((F.col("src") != target) & (F.col("dst") != source))
    if max_length is not None:
        live = live.where(F.col("a") + F.col("b") + 1 <= max_length)
    return checkpointed(live.select(F.col("src").alias("at"), "dst", "weight", "b", F.struct("src", "dst", "relation_type", "weight").alias("edge")))


def _first(graph: KGraph, source: str, edges: bool) -> DataFrame:
    """The path without an edge: its open form, from which others grow, or the whole one."""
    one = graph.spark.range(1)
    nodes = F.array(F.lit(source)) if edges else F.array().cast("array<string>")
    return one.select(nodes.alias("nodes"), F.array().cast(_EDGE).alias("edges"), F.lit(0.0).alias("total_weight"), F.lit(source).alias("at"))


def _grown(front: DataFrame, step: DataFrame, max_length: int | None) -> DataFrame:
    """front with each edge that leads to a new node, as far as the target can still be reached in time."""
    out = front.join(step, "at").where(~F.array_contains("nodes", F.col("dst")))
    if max_length is not None:
        out = out.where(F.size("edges") + 1 + F.col("b") <= max_length)
    return out.select(F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("edges", F.array("edge")).alias("edges"), (F.col("total_weight") + F.col("weight")).alias("total_weight"), F.col("dst").alias("at"))


def _kept(found: DataFrame, keep: Callable[[Column], Column] | Column | None) -> DataFrame:
    found = found.select("nodes", "edges", "total_weight", F.size("edges").alias("length"))
    return found if keep is None else found.where(keep(F.col("edges")) if callable(keep) and not isinstance(keep, Column) else keep)


def simple_paths(graph: KGraph, source: str, target: str, max_length: int | None = None, weight: Column | None = None, keep: Callable[[Column], Column] | Column | None = None) -> DataFrame:
    """nodes, edges, total_weight, length of every path that repeats no node; keep is a condition on these columns.

    Paths grow by one join a round and rest once they reach the target. Only edges on some walk from source to target within
    max_length take part.
    """
    none = _first(graph, source, edges=False)
    if not graph.has_node(source) or not graph.has_node(target):
        return _kept(none.where("false"), keep)
    if source == target:
        return _kept(none, keep)
    step = _live_edges(graph, source, target, max_length, weight)
    front, now, done = _first(graph, source, edges=True), {"n": 1}, none.where("false")
    while now["n"]:
        grown = checkpointed(_grown(front, step, max_length))
        done = done.union(grown.where(F.col("at") == target))
        front, now = counted(grown.where(F.col("at") != target))
    return _kept(done, keep)


#: Open paths that all_paths() lengthens in one round.
WAVE = 1000


def all_paths(graph: KGraph, source: str, target: str, max_length: int | None = None, max_paths: int | None = None, keep: Callable[[Column], Column] | Column | None = None, weight: Column | None = None) -> DataFrame:
    """The first max_paths simple paths in the order of their nodes, of those that keep accepts.

    Each round lengthens the least open paths only, at most WAVE of them, as a search in depth would; once max_paths whole paths
    are known, open ones beyond the last of them are given up, and the search ends when none is open.
    """
    for name, value in (("max_length", max_length), ("max_paths", max_paths)):
        if value is not None and value <= 0:
            raise ValueError(f"{name} is {value}, but only a positive number makes sense")
    require(graph, source, "Start")
    require(graph, target, "End")
    max_length, max_paths = max_length or MAX_LENGTH, max_paths or MAX_PATHS
    none = _first(graph, source, edges=False)
    if source == target:
        return _kept(none, keep)
    step = _live_edges(graph, source, target, max_length, weight)
    opened, now, done, last = _first(graph, source, edges=True), {"n": 1}, _kept(none.where("false"), keep), None
    while now["n"]:
        wave, rest = opened, None
        if now["n"] > WAVE:
            bound = opened.select("nodes").orderBy("nodes").offset(WAVE - 1).first()["nodes"]
            wave, rest = opened.where(F.col("nodes") <= F.lit(bound)), opened.where(F.col("nodes") > F.lit(bound))
        grown = checkpointed(_grown(wave, step, max_length))
        done, whole = counted(done.union(_kept(grown.where(F.col("at") == target), keep)).orderBy("nodes").limit(max_paths), F.max("nodes").alias("last"))
        if whole["n"] >= max_paths:
            last = whole["last"]
        still = grown.where(F.col("at") != target)
        still = still if rest is None else still.union(rest)
        opened, now = counted(still if last is None else still.where(F.col("nodes") < F.lit(last)))
    return done.orderBy("nodes")


def find_paths(graph: KGraph, source: str, target: str, path_type: str = SHORTEST, **options) -> PathResult | DataFrame:
    if path_type == SHORTEST:
        return shortest_path(graph, source, target, options.get("weight"))
    if path_type in (ALL, FILTERED):
        return all_paths(graph, source, target, **options)
    raise ValueError(f"Unknown path type: {path_type}")
