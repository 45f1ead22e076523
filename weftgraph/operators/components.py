"""Weak and strong components, and clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import KGraph
from ..runtime import checkpointed, counted, dealt_by


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of it and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    return joined.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(joined.select(F.col("m").alias("a"), "b"))


def star_components(links: DataFrame) -> DataFrame:
    """node, component (the least node that can be reached) for each node in links (a, b of any ordered type; a < b).

    Both steps keep the components and take a node's minimum by a partial aggregate before its links are joined to it, so a
    node with very many links costs one row a task in the aggregate and can be split in the join. The rounds grow with the
    logarithm of the number of nodes; each is cut from its lineage in the shared folder. The driver sees two numbers a round.
    """
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("mark")
    edges, before = counted(links.select("a", "b").where("a < b").distinct(), mark)
    while before["n"]:
        edges, now = counted(_small_star(_large_star(edges).distinct()).distinct(), mark)
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())


def weak_components(graph: KGraph) -> DataFrame:
    """node, component (its least node) of every node."""
    links = graph.edges().where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    found = star_components(links)
    return graph.nodes().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("size"))


def _spread(edges: DataFrame, label: DataFrame) -> DataFrame:
    """label (node, color): the least color that reaches each node flows along the edges, from the nodes whose color changed
    last, until none changes; one job a round."""
    moved = F.count_if("moved").alias("moved")
    with dealt_by(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")), "node") as steps:
        label, now = counted(label.select("node", "color", F.lit(True).alias("moved")), moved)
        while now["moved"]:
            offered = label.where("moved").join(steps, "node").groupBy(F.col("next").alias("node")).agg(F.min("color").alias("new"))
            better = F.coalesce(F.col("new") < F.col("color"), F.lit(False))
            label, now = counted(label.drop("moved").join(offered, "node", "left").select("node", F.when(better, F.col("new")).otherwise(F.col("color")).alias("color"), better.alias("moved")), moved)
    return label.select("node", "color")


def strong_components(graph: KGraph) -> DataFrame:
    """node, component (its least node): nodes that reach each other.

    Trim and colour: nodes without edges in or out among the rest are components by themselves; then each node takes the least
    node that reaches it as its colour, and those of a colour that reach the colour's root backwards are its component.
    """
    live = checkpointed(graph.edges().where("src <> dst").select("src", "dst"))
    rest, left = counted(graph.nodes())
    done = rest.select("node", F.col("node").alias("component")).where("false")
    inside = lambda nodes: live.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    while left["n"]:
        ends = live.select(F.col("src").alias("node")).intersect(live.select(F.col("dst").alias("node")))
        inner, kept = counted(rest.join(ends, "node", "left_semi"))
        if kept["n"] < left["n"]:  # trim a layer
            done = checkpointed(done.union(rest.join(inner, "node", "left_anti").select("node", F.col("node").alias("component"))))
            rest, left, live = inner, kept, checkpointed(inside(inner))
            continue
        color = _spread(live, rest.withColumn("color", F.col("node")))
        src, dst = color.select(F.col("node").alias("src"), F.col("color").alias("cs")), color.select(F.col("node").alias("dst"), F.col("color").alias("cd"))
        back = checkpointed(live.join(src, "src").join(dst, "dst").where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        from .traversal import expand

        found = expand(back, color.where("node = color").select("node")).select("node")
        done = checkpointed(done.union(color.join(found, "node").select("node", F.col("color").alias("component"))))
        rest, left = counted(rest.join(done, "node", "left_anti"))
        if left["n"]:
            live = checkpointed(inside(rest))
    return done


def clustering(graph: KGraph) -> DataFrame:
    """node, neighbors, coefficient: directed links among a node's neighbours (either direction, without itself) / (k (k - 1)).

    Each triangle is found once, from its corner of least degree, so hubs do not pair up all their neighbours.
    """
    edges = graph.edges().where("src <> dst").select("src", "dst")
    ways = checkpointed(edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("ways")))
    degree = checkpointed(ways.select("a").union(ways.select("b")).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("k")))
    da, db = degree.select(F.col("node").alias("a"), F.col("k").alias("ka")), degree.select(F.col("node").alias("b"), F.col("k").alias("kb"))
    first = (F.col("ka") < F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")))
    up = checkpointed(ways.join(da, "a").join(db, "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("high"), "ways"))
    wedges = up.select("low", F.col("high").alias("p"), F.col("ways").alias("wp")).join(up.select("low", F.col("high").alias("q"), F.col("ways").alias("wq")), "low").where("p < q")
    triangles = wedges.join(ways, (F.col("p") == F.col("a")) & (F.col("q") == F.col("b")))
    corner = F.explode(F.array(F.struct(F.col("low").alias("node"), F.col("ways").alias("links")), F.struct(F.col("p").alias("node"), F.col("wq").alias("links")), F.struct(F.col("q").alias("node"), F.col("wp").alias("links"))))
    links = triangles.select(corner.alias("t")).groupBy("t.node").agg(F.sum("t.links").alias("links"))
    k = F.coalesce("k", F.lit(0))
    share = F.when(k < 2, 0.0).otherwise(F.coalesce("links", F.lit(0)) / (k * (k - 1)))
    return graph.nodes().join(degree, "node", "left").join(links, "node", "left").select("node", k.cast("long").alias("neighbors"), share.alias("coefficient"))


def clustering_of(graph: KGraph, nodes: DataFrame) -> DataFrame:
    """As clustering(), of nodes (column node) only: the edges read beside theirs are those of their neighbours."""
    edges = graph.edges().where("src <> dst").select("src", "dst")
    nodes = nodes.select("node").distinct()
    out = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("near"))
    into = edges.join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("dst").alias("node"), F.col("src").alias("near"))
    near = checkpointed(out.union(into).distinct())
    beyond = edges.join(near.withColumnRenamed("near", "src"), "src").select("node", F.col("dst").alias("near"))
    links = beyond.join(near, ["node", "near"]).groupBy("node").agg(F.count("*").alias("links"))
    k = near.groupBy("node").agg(F.count("*").alias("k"))
    n = F.coalesce("k", F.lit(0))
    share = F.when(n < 2, 0.0).otherwise(F.coalesce("links", F.lit(0)) / (n * (n - 1)))
    return nodes.join(k, "node", "left").join(links, "node", "left").select("node", n.cast("long").alias("neighbors"), share.alias("coefficient"))
