"""Breadth-first and depth-first traversal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NodeNotFoundError
from ..graph import KGraph
from ..runtime import checkpointed, counted, dealt_by, numbered, one_row, scratch, stored

BFS, ITERATIVE_DFS, RECURSIVE_DFS = "bfs", "iterative_dfs", "recursive_dfs"
Predicate = Column | Callable[[Column], Column] | None


def as_predicate(p: Predicate, node: str = "node") -> Column | None:
    """A Column over the column node, or a function from that column to one."""
    return p(F.col(node)) if callable(p) and not isinstance(p, Column) else p


def require(graph: KGraph, node: str, what: str = "Start") -> None:
    if not graph.has_node(node):
        raise NodeNotFoundError(f"{what} node '{node}' not found in the graph")


#: Rounds after which what has been seen is written anew, so that plans stay short on deep graphs.
FOLD = 8


def expand(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, only: Column | None = None, keys: tuple[str, ...] = (), paths: bool = False) -> DataFrame:
    """keys, node, depth[, path] of all nodes that edges reach from seeds (keys, node); `only` is a condition on entered nodes.

    One join and one anti-join a level, over the new nodes only, in one job. path (if asked for) is the least of the paths of
    fewest edges, by node names in order, so ordering by (depth, path) gives the order in which a queue with sorted neighbours
    meets the nodes.
    """
    on = [*keys, "node"]
    way = [F.array("node").alias("path")] if paths else []
    front, now = counted(seeds.select(*on).distinct().select(*on, F.lit(0).alias("depth"), *way))
    seen, depth = front, 0
    with dealt_by(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")), "node") as steps:
        while (max_depth is None or depth < max_depth) and now["n"]:
            depth += 1
            new = front.join(steps, "node").select(*keys, F.col("next").alias("node"), *(["path"] if paths else []))
            if only is not None:
                new = new.where(only)
            new = (new.groupBy(*on).agg(F.min("path").alias("path")) if paths else new.distinct()).join(seen.select(*on), on, "left_anti")
            way = [F.concat("path", F.array("node")).alias("path")] if paths else []
            front, now = counted(new.select(*on, F.lit(depth).alias("depth"), *way))
            seen = seen.union(front)
            if depth % FOLD == 0:
                seen = checkpointed(seen)
    return seen


def bfs(graph: KGraph, start: str, max_depth: int | None = None, emit: Predicate = None, prune: Predicate = None, paths: bool = True) -> DataFrame:
    """node, depth[, path] of what can be reached from start, by levels.

    emit hides nodes but is walked through (nothing at all if start fails it); prune also stops the walk.
    """
    require(graph, start)
    start_row = one_row(graph.spark, node=start)
    for p in (as_predicate(emit), as_predicate(prune)):
        if p is not None and start_row.where(p).isEmpty():
            return start_row.select("node", F.lit(0).alias("depth"), *([F.array("node").alias("path")] if paths else [])).where("false")
    found = expand(graph.edges(), start_row, max_depth, as_predicate(prune), paths=paths)
    return found if emit is None else found.where(as_predicate(emit))


def dfs(graph: KGraph, start: str, max_depth: int | None = None, prune: Predicate = None) -> DataFrame:
    """visit_order, node, depth in preorder with neighbours in ascending order; nodes that fail prune are not entered.

    If no node is entered by two edges, the order is that of shallow_preorder(). Otherwise, or in deep trees, what can be reached is
    found in parallel. If its edges are a tree, so is the order, by tree_preorder(). Otherwise it depends on everything visited
    before, and the walk is one task over the edges among those nodes, already filtered.
    """
    require(graph, start)
    schema = "visit_order long, node string, depth int"
    p = as_predicate(prune)
    one = one_row(graph.spark, node=start)
    if p is not None and one.where(p).isEmpty():
        return graph.spark.createDataFrame([], schema)
    ways = graph.edges().select("src", F.col("dst").alias("node")).where((F.col("src") != F.col("node")) & (F.col("node") != start))
    if (found := shallow_preorder((ways if p is None else ways.where(p)).select("src", F.col("node").alias("dst")), start)) is not None:
        return found if max_depth is None else _renumbered(found.where(F.col("depth") <= max_depth))
    inside = checkpointed(expand(graph.edges(), one, max_depth, p).select("node", "depth"))
    edges = graph.edges().select("src", "dst").join(inside.select(F.col("node").alias("src")), "src", "left_semi").join(inside.select(F.col("node").alias("dst")), "dst", "left_semi")

    edges = checkpointed(edges.where((F.col("src") != F.col("dst")) & (F.col("dst") != start)))  # the others lead to what is visited already
    if edges.count() == inside.count() - 1:
        return tree_preorder(edges, start).join(inside, "node").select("visit_order", "node", "depth")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        after: dict[str, list[str]] = {}
        for f in frames:
            for s, d in zip(f["src"], f["dst"], strict=True):
                after.setdefault(s, []).append(d)
        visited: set[str] = set()
        rows, stack = [], [(start, 0)]
        while stack:
            node, depth = stack.pop()
            if node in visited:
                continue
            visited.add(node)
            rows.append((len(rows), node, depth))
            if max_depth is None or depth < max_depth:
                stack += [(n, depth + 1) for n in sorted(after.get(node, ()), reverse=True) if n not in visited]
        yield pd.DataFrame(rows, columns=["visit_order", "node", "depth"])

    return edges.coalesce(1).mapInPandas(walk, schema)


#: Rows below which the leaves of a tree are no longer taken off; bytes of the longest way for which ways are kept.
CORE, LONGEST_WAY = 1_000_000, 128


def _placed(rows: DataFrame, order: str) -> DataFrame:
    """rows with place: their number in ascending order, from 0."""
    return numbered(rows.repartitionByRange(order).sortWithinPartitions(order).drop(order))


def _renumbered(found: DataFrame) -> DataFrame:
    return _placed(found, "visit_order").select(F.col("place").alias("visit_order"), "node", "depth")


def _sibling_ranks(edges: DataFrame) -> DataFrame:
    """node, parent, rank: the number of each edge (src, dst) among those of its src, by dst, from 0. Edges are dealt by ranges and
    numbered range by range, so the edges of a node may fill any number of tasks."""
    ranged = edges.select("src", "dst").repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").select("*", F.spark_partition_id().alias("range"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            src, at = batch["src"], np.arange(batch.num_rows)
            new = np.concatenate([[src[0].as_py() != last], pc.not_equal(src[1:], src[:-1]).to_numpy(zero_copy_only=False)])
            since = np.maximum.accumulate(np.where(new, at, -1))
            rank = np.where(since < 0, at + n, at - since)
            yield pa.RecordBatch.from_arrays([batch["dst"], src, batch["range"], pa.array(rank, pa.int64())], names=["node", "parent", "range", "rank"])
            last, n = src[-1].as_py(), int(rank[-1]) + 1

    held = stored(ranged.mapInArrow(number, "node string, parent string, range int, rank long"))
    # Of a node whose edges fill several ranges, those of the ranges before count too.
    ends = held.groupBy("range").agg(F.min("parent").alias("low"), F.max("parent").alias("high"))
    outer = held.join(F.broadcast(ends), "range").where("parent = low or parent = high").groupBy("parent", "range").agg(F.count("*").alias("n"))
    cut, seen = [], {}
    for r in outer.orderBy("parent", "range").collect():  # two rows at most for each range
        if n := seen.get(r["parent"], 0):
            cut.append((r["range"], r["parent"], n))
        seen[r["parent"]] = n + r["n"]
    if cut:
        more = F.broadcast(edges.sparkSession.createDataFrame(cut, "range int, parent string, more long"))
        held = held.join(more, ["range", "parent"], "left").withColumn("rank", F.col("rank") + F.coalesce("more", F.lit(0)))
    return held.select("node", "parent", "rank")


def _code(rank: Column) -> Column:
    """Bytes in the order of the numbers, none the beginning of another: one up to 239, else their count and they themselves."""
    digits = F.hex(rank)
    size = F.ceil(F.length(digits) / 2)
    return F.unhex(F.when(rank < 240, F.lpad(digits, 2, "0")).otherwise(F.concat(F.hex(F.lit(0xEF) + size), F.lpad(digits, 2 * size, F.lit("0")))))


def _jumped(rows: DataFrame, n: int, root: str) -> DataFrame | None:
    """node, way, depth of the n rows (node, parent, way) below root by doubled jumps towards it, or None if a way is too long."""
    ways = stored(rows.select("node", F.col("parent").alias("to"), "way", F.lit(1).alias("depth")))
    for _ in range(n.bit_length() + 1):
        now = ways.agg(F.count_if(F.col("to") != root).alias("open"), F.max(F.length("way")).alias("longest")).first()
        if not now["open"]:
            break
        if now["longest"] > LONGEST_WAY:
            return None
        ahead = ways.select(F.col("node").alias("to"), F.col("to").alias("beyond"), F.col("way").alias("before"), F.col("depth").alias("more"))
        # A row whose jump ends in no node is below another root.
        jumped = ways.join(ahead, "to", "left").where((F.col("to") == root) | F.col("beyond").isNotNull())
        ways = stored(jumped.select("node", F.coalesce("beyond", "to").alias("to"), F.when(F.col("before").isNull(), F.col("way")).otherwise(F.concat("before", "way")).alias("way"), (F.col("depth") + F.coalesce("more", F.lit(0))).cast("int").alias("depth")))
    # What has not arrived by now goes round a cycle.
    return ways.where(F.col("to") == root).select("node", "way", "depth")


def shallow_preorder(edges: DataFrame, root: str) -> DataFrame | None:
    """visit_order, node, depth of what edges (src, dst) reach from root, neighbours in ascending order; None if edges share a dst or
    ways are too long.

    The way to a node is the ranks of its ancestors and itself among their siblings, as bytes; their order is the preorder. Leaves
    are taken off, layer by layer, while there are many; the ways of the rest are found by doubled jumps, and each layer adds its
    ranks to those of its parents. So few rows jump, and no round is needed for each level.
    """
    spark = edges.sparkSession
    with scratch(spark) as made:
        ranked = _sibling_ranks(edges)
        n = ranked.count()
        if ranked.select("node").distinct().count() < n:
            return None
        layers, inner = [], ranked.select("node", "parent", _code(F.col("rank")).alias("way"))
        while n > CORE:
            layers.append(inner)
            inner = stored(inner.join(inner.select(F.col("parent").alias("node")).distinct(), "node", "left_semi"))
            before, n = n, inner.count()
            if n > 0.75 * before:
                break
        ways = _jumped(inner, n, root)
        if ways is None:
            return None
        top = one_row(spark, node=root, way=b"", depth=0)
        for layer in reversed(layers):
            above = ways.union(top).select(F.col("node").alias("parent"), F.col("way").alias("before"), F.col("depth").alias("above"))
            ways = stored(layer.join(above, "parent").select("node", F.concat("before", "way").alias("way"), (F.col("above") + 1).alias("depth")))
        found = _placed(ways.union(top), "way").select(F.col("place").alias("visit_order"), "node", "depth")
        made.pop()  # the placed rows stay
    return found


def next_in_group(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows with next: the next greater value of order in the same group, or null. Rows are dealt by ranges of both and looked at range
    by range, so a group may fill any number of tasks."""
    ranged = rows.repartitionByRange(group, order).sortWithinPartitions(group, order)
    held = stored(ranged.select("*", F.spark_partition_id().alias("range")))
    within = held.withColumn("within", F.lead(order).over(Window.partitionBy("range", group).orderBy(order)))
    firsts = held.groupBy(group, "range").agg(F.min(order).alias("first"))  # a row for each range and group in it
    beyond = firsts.select(group, "range", F.lead("first").over(Window.partitionBy(group).orderBy("range")).alias("beyond"))
    return within.join(beyond, [group, "range"]).select(*rows.columns, F.coalesce("within", "beyond").alias("next"))


def tree_preorder(edges: DataFrame, root: str) -> DataFrame:
    """visit_order, node of a tree of edges (src, dst) below root, neighbours in ascending order.

    An Euler tour as a linked list: each node is entered (one step) and left (none); after entering come the first child or the
    leaving, after leaving the next sibling or the leaving of the parent. How many are entered from a place on is found by doubled
    jumps, as many as the logarithm of the tour's length, over all nodes at once.
    """
    children = next_in_group(edges.select("src", "dst"), "src", "dst")
    first = edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("child"))
    top = one_row(edges.sparkSession, node=root, parent=None, sibling=None).select("node", F.col("parent").cast("string"), F.col("sibling").cast("string"))
    nodes = children.select(F.col("dst").alias("node"), F.col("src").alias("parent"), F.col("next").alias("sibling")).unionByName(top).join(first, "node", "left")
    at = lambda what, node: F.struct(F.lit(what).alias("what"), node.alias("node"))
    enter, leave = 1, 0
    entered = F.when(F.col("child").isNotNull(), at(enter, F.col("child"))).otherwise(at(leave, F.col("node")))
    left = F.when(F.col("sibling").isNotNull(), at(enter, F.col("sibling"))).when(F.col("parent").isNotNull(), at(leave, F.col("parent")))
    both = F.array(F.struct(at(enter, F.col("node")).alias("place"), entered.alias("to"), F.lit(1).cast("long").alias("steps")), F.struct(at(leave, F.col("node")).alias("place"), left.alias("to"), F.lit(0).cast("long").alias("steps")))
    tour = checkpointed(nodes.select(F.explode(both).alias("t")).select("t.*"))
    places = tour.count()
    for _ in range(places.bit_length()):
        ahead = tour.select(F.col("place").alias("to"), F.col("to").alias("beyond"), F.col("steps").alias("more"))
        jumped = tour.join(ahead, "to", "left").select("place", F.col("beyond").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        tour, now = counted(jumped, F.count("to").alias("open"))
        if not now["open"]:
            break
    entered = tour.where(F.col("place.what") == enter)
    return entered.select((F.lit(places // 2) - F.col("steps")).cast("long").alias("visit_order"), F.col("place.node").alias("node"))


def traverse(graph: KGraph, start: str, strategy: str = BFS, max_depth: int | None = None, where: Predicate = None) -> DataFrame:
    """By strategy: bfs hides what fails the condition, both kinds of dfs (which give the same rows) do not enter it."""
    if strategy == BFS:
        return bfs(graph, start, max_depth, emit=where)
    if strategy in (ITERATIVE_DFS, RECURSIVE_DFS):
        return dfs(graph, start, max_depth, prune=where)
    raise ValueError(f"Unknown strategy: {strategy}")


def emission_order(found: DataFrame) -> DataFrame:
    return found.orderBy("depth", "path")
