"""Metrics of a whole graph, exact and sampled."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import KGraph
from ..runtime import checkpointed, dealt_by, numbered, remove, scratch, stored
from .components import clustering, clustering_of, weak_components
from .traversal import expand

#: Up to these node counts the exact forms run; above, samples of at least MIN_SAMPLE or the root of the count.
EXACT_PATHS_BELOW, EXACT_CLUSTERING_BELOW, MIN_SAMPLE = 1000, 5000, 100


@dataclass
class GraphMetrics:
    node_count: int
    edge_count: int
    average_degree: float
    density: float
    degree_distribution: dict[int, int]
    clustering_coefficient: float
    connected_components: int
    diameter: int | None
    average_path_length: float
    confidence: float


def basic(graph: KGraph) -> DataFrame:
    """One row: node_count, edge_count, average_degree (2 E / N), density (self-loops count)."""
    n = graph.nodes().agg(F.count("*").alias("node_count"))
    e = graph.edges().agg(F.count("*").alias("edge_count"))
    nodes, edges = F.col("node_count"), F.col("edge_count")
    density = F.when(nodes == 0, 0.0).when(nodes == 1, F.when(edges > 0, 1.0).otherwise(0.0)).otherwise(edges / (nodes * (nodes - 1)))
    return n.join(e).select("node_count", "edge_count", F.when(nodes == 0, 0.0).otherwise(2 * edges / nodes).alias("average_degree"), density.alias("density"))  # two single rows


def degree_distribution(graph: KGraph) -> DataFrame:
    """degree, nodes: how many nodes have each out-degree, 0 included."""
    return graph.degrees().groupBy("degree").agg(F.count("*").alias("nodes"))


def degree_centrality(graph: KGraph) -> DataFrame:
    """node, centrality: out-degree / (N - 1); 0 for a single node."""
    n = graph.nodes().agg(F.count("*").alias("n"))  # one row
    return graph.degrees().join(n).select("node", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(0.0).alias("centrality"))


def average_clustering(graph: KGraph) -> DataFrame:
    return clustering(graph).agg(F.coalesce(F.avg("coefficient"), F.lit(0.0)).alias("clustering_coefficient"))


def sample_nodes(graph: KGraph, size: int, seed: int = 0) -> DataFrame:
    """The `size` nodes whose MD5, of name, ':' and seed, is the smallest text."""
    return graph.nodes().orderBy(F.md5(F.concat("node", F.lit(f":{seed}")).cast("binary")), "node").limit(size)


def sample_size(n: int) -> int:
    return min(n, max(MIN_SAMPLE, int(n**0.5)))


def clustering_sampled(graph: KGraph, size: int | None = None, seed: int = 0) -> DataFrame:
    """mean, confidence (1 - 2 standard errors; 1 below two nodes), sample_size over a seeded sample."""
    size = sample_size(graph.node_count()) if size is None else size
    found = clustering_of(graph, sample_nodes(graph, size, seed))
    n, error = F.count("*"), F.stddev_samp("coefficient") / F.sqrt(F.count("*"))
    return found.agg(F.coalesce(F.avg("coefficient"), F.lit(0.0)).alias("mean"), F.when(n < 2, 1.0).otherwise(1 - 2 * error).alias("confidence"), n.alias("sample_size"))


def pair_distances(graph: KGraph, sources: DataFrame | None = None) -> DataFrame:
    """source, node, depth of all ordered pairs that can be reached, from sources (all nodes if None), without pairs of equals."""
    seeds = (graph.nodes() if sources is None else sources).select(F.col("node").alias("source"), "node")
    return expand(graph.edges(), seeds, keys=("source",)).where("depth > 0").select("source", "node", "depth")


#: Edges and nodes up to which a graph is held by each worker; bytes of its words for one batch of sources; most words of a batch;
#: most edges into a node that are joined at once; rows of one batch of sources where the graph is not held.
HELD_EDGES, HELD_NODES, BATCH_BYTES, BATCH_WORDS, WIDE, BATCH_ROWS = 40_000_000, 4_000_000, 100_000_000, 16, 256, 20_000_000


def distance_counts(graph: KGraph, sources: DataFrame | None = None) -> DataFrame:
    """depth, pairs: how many ordered pairs of different nodes have each distance, from sources (all nodes if None).

    A node's words hold a bit for each source that has reached it, so a step is a bitwise or over 64 sources at once. A graph that
    fits into a worker is sent to all, as numbers: a task takes a batch of sources through all levels in its memory, and only
    the counts leave it. In a larger one a step is a join, for a bounded number of words at a time.
    """
    spark = graph.spark
    with scratch(spark):
        nodes = numbered(graph.nodes())
        n = nodes.count()
        at = lambda end: nodes.select(F.col("node").alias(end), F.col("place").cast("int").alias(end[0]))
        chosen = None if sources is None else sources.select("node").distinct().join(nodes, "node").select("place")
        links = graph.edges().where("src <> dst").select("src", "dst")
        if n > HELD_NODES or (size := links.count()) > HELD_EDGES:
            return _joined_counts(links, nodes if sources is None else sources.select("node").distinct().join(nodes, "node"), n)
        # dealt by ranges of the end, so that what arrives part by part stands in its order
        ends = stored(links.join(at("src"), "src").join(at("dst"), "dst").select("s", "d").repartitionByRange("d").sortWithinPartitions("d"))
        held = spark.sparkContext.broadcast(_packed(ends, size, n))
        first = np.arange(n, dtype=np.int32) if chosen is None else np.array([r["place"] for r in chosen.collect()], np.int32)  # numbers of nodes, HELD_NODES at most
        begin = spark.sparkContext.broadcast(first)
        words = max(1, min(BATCH_WORDS, BATCH_BYTES // (32 * max(n, 1))))
        batches = -(-len(first) // (64 * words))

        def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            stages, moved = held.value
            for frame in frames:
                for i in frame["id"].to_pylist():
                    pairs = _levels(stages, n, moved[begin.value[i * 64 * words : (i + 1) * 64 * words]])
                    yield pa.RecordBatch.from_arrays([pa.array(range(1, len(pairs) + 1), pa.int32()), pa.array(pairs, pa.int64())], names=["depth", "found"])

        found = spark.range(0, batches, 1, max(1, min(batches, 1000))).mapInArrow(count, "depth int, found long")
        counts = checkpointed(found.groupBy("depth").agg(F.sum("found").alias("pairs")))
        held.unpersist()
        begin.unpersist()
    return counts


def _packed(ends: DataFrame, size: int, n: int) -> tuple[list, np.ndarray]:
    """Of `size` edges (s, d) between the numbers below n, in the order of d: the stages of _pulled() and the new number of each node.

    Nodes are numbered anew, those with most edges in first. A stage's rows, by falling number of entries, hold as columns the k-th entries of
    all rows that have so many. Nodes with over WIDE edges in are several rows of one stage, which the next one joins.
    """
    entries, counts, held = np.empty(size, np.int32), np.zeros(n, np.int64), 0
    for s, d in _parts(ends):
        entries[held : held + len(s)] = s
        counts += np.bincount(d, minlength=n)
        held += len(s)
    order = np.argsort(-counts, kind="stable")
    moved = np.empty(n, np.int32)
    moved[order] = np.arange(n, dtype=np.int32)
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1][order]
    entries, counts, stages = moved[entries], counts[order], []
    while counts.max(initial=0) > WIDE:
        pieces = -(-counts // WIDE)
        owner = np.repeat(np.arange(len(counts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size, begin = np.minimum(WIDE, counts[owner] - nth * WIDE), starts[owner] + nth * WIDE
        rows = np.argsort(-size, kind="stable")
        stages.append((len(rows), _columns(entries, size[rows], begin[rows])))
        entries = np.empty(len(rows), np.int32)
        entries[rows] = np.arange(len(rows), dtype=np.int32)
        starts, counts = np.cumsum(pieces) - pieces, pieces
    stages.append((len(counts), _columns(entries, counts, starts)))
    return stages, moved


def _parts(ends: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The columns s and d, part by part, so that neither the JVM nor Python holds more than a part beside what is kept."""

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            yield pa.RecordBatch.from_arrays([pa.array([f[c].to_numpy().astype(np.int32).tobytes()], pa.binary()) for c in ("s", "d")], names=["s", "d"])

    for row in ends.mapInArrow(pack, "s binary, d binary").toLocalIterator():
        yield np.frombuffer(row["s"], np.int32), np.frombuffer(row["d"], np.int32)


def _columns(entries: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    most = int(counts.max(initial=0))
    longer = np.searchsorted(-counts, -np.arange(most), side="left")  # how many rows have over k entries
    return [entries[starts[:m] + k] for k, m in enumerate(longer.tolist())]


def _pulled(stages: list, front: np.ndarray) -> np.ndarray:
    """Of each node, the words of the nodes before it, joined by or."""
    for rows, columns in stages:
        out = np.zeros((rows, front.shape[1]), np.uint64)
        space = np.empty((len(columns[0]) if columns else 0, front.shape[1]), np.uint64)
        for k, column in enumerate(columns):
            m = len(column)
            np.take(front, column, axis=0, out=space[:m] if k else out[:m], mode="clip")  # with raise, take would copy out
            if k:
                np.bitwise_or(out[:m], space[:m], out=out[:m])
        front = out
    return front


def _levels(stages: list, n: int, sources: np.ndarray) -> list[int]:
    """How many pairs of a source and another node have the distances 1, 2, ..."""
    at = np.arange(len(sources))
    seen = np.zeros((n, -(-len(sources) // 64)), np.uint64)
    np.bitwise_or.at(seen, (sources, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    front, pairs = seen.copy(), []
    while True:
        new = _pulled(stages, front)
        np.bitwise_and(new, np.bitwise_not(seen, out=front), out=new)
        if not (found := int(np.bitwise_count(new).sum(dtype=np.int64))):
            return pairs
        pairs.append(found)
        np.bitwise_or(seen, new, out=seen)
        front = new


def _joined_counts(links: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """distance_counts() by joins: rows of a word of 64 sources (node, place) and a node, for so many words at a time that they are
    BATCH_ROWS rows at most, or one word. What a level leaves goes once the next ones are written."""
    spark = links.sparkSession
    seeds = numbered(sources.select("node")).groupBy(F.expr("place div 64").alias("word"), "node").agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
    seeds = stored(seeds)
    most = (seeds.agg(F.max("word")).first()[0] or 0) + 1
    share = max(1, BATCH_ROWS // max(n, 1))
    total: dict[int, int] = {}
    with dealt_by(links.select(F.col("src").alias("node"), F.col("dst").alias("next")), "node") as steps:
        for low in range(0, most, share):
            front = seen = seeds.where((F.col("word") >= low) & (F.col("word") < low + share))
            depth, kept = 0, []
            while True:
                depth += 1
                with scratch(spark) as made:
                    reach = front.join(steps, "node").groupBy("word", F.col("next").alias("node")).agg(F.bit_or("bits").alias("bits"))
                    fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
                    new = stored(reach.join(seen.withColumnRenamed("bits", "old"), ["word", "node"], "left").select("word", "node", fresh.alias("bits")).where("bits <> 0"))
                    pairs = new.agg(F.sum(F.bit_count("bits"))).first()[0]
                    if not pairs:
                        break
                    total[depth] = total.get(depth, 0) + pairs
                    seen, front = stored(seen.union(new).groupBy("word", "node").agg(F.bit_or("bits").alias("bits"))), new
                    stay, made[:] = list(made), []
                remove(spark, kept)
                kept = stay
            remove(spark, kept)
    return spark.createDataFrame(list(total.items()), "depth int, pairs long")  # a row for each depth


def _of_counts(counts: DataFrame) -> tuple[Column, Column, Column]:
    """Of the columns depth and pairs: the number of pairs, and mean and sample deviation of their distance."""
    n, total, squares = F.coalesce(F.sum("pairs"), F.lit(0)), F.sum(F.col("depth") * F.col("pairs")), F.sum(F.col("depth") * F.col("depth") * F.col("pairs"))
    deviation = F.when(n > 1, F.sqrt(F.greatest((squares - total * total / n) / (n - 1), F.lit(0.0))))
    return n, F.when(n > 0, total / n).otherwise(0.0), deviation


def path_metrics(graph: KGraph) -> DataFrame:
    """One row, exact: diameter (null if any ordered pair cannot be reached), average_path_length over those that can, sample_size, confidence."""
    n = graph.node_count()
    if n <= 1:
        return graph.spark.createDataFrame([(0 if n else None, 0.0, n, 1.0)], "diameter int, average_path_length double, sample_size long, confidence double")
    counts = distance_counts(graph)
    pairs, mean, _ = _of_counts(counts)
    return counts.agg(F.when(pairs == n * (n - 1), F.max("depth")).alias("diameter"), mean.alias("average_path_length"), F.lit(n).cast("long").alias("sample_size"), F.lit(1.0).alias("confidence"))


def path_metrics_sampled(graph: KGraph, size: int | None = None, seed: int = 0) -> DataFrame:
    """As path_metrics, from landmarks: diameter is the estimate int(1.5 x the largest depth seen), observed_diameter that depth."""
    size = sample_size(graph.node_count()) if size is None else size
    counts = distance_counts(graph, sample_nodes(graph, size, seed))
    n, mean, deviation = _of_counts(counts)
    confidence = F.when(n == 0, 0.0).when(n == 1, 1.0).otherwise(1 - 2 * deviation / F.sqrt(n))
    return counts.agg(F.floor(F.max("depth") * 1.5).cast("int").alias("diameter"), mean.alias("average_path_length"), F.lit(size).cast("long").alias("sample_size"), confidence.alias("confidence"), F.max("depth").alias("observed_diameter"))


def calculate(graph: KGraph, exact_paths_below: int = EXACT_PATHS_BELOW, exact_clustering_below: int = EXACT_CLUSTERING_BELOW, seed: int = 0) -> GraphMetrics:
    """All metrics; beyond the thresholds clustering and paths are sampled."""
    b = basic(graph).first()
    if not b["node_count"]:
        return GraphMetrics(0, 0, 0.0, 0.0, {}, 0.0, 0, None, 0.0, 1.0)
    near = average_clustering(graph).first()[0] if b["node_count"] < exact_clustering_below else clustering_sampled(graph, seed=seed).first()["mean"]
    paths = (path_metrics(graph) if b["node_count"] < exact_paths_below else path_metrics_sampled(graph, seed=seed)).first()
    histogram = {r["degree"]: r["nodes"] for r in degree_distribution(graph).collect()}  # a row for each degree
    parts = weak_components(graph).select("component").distinct().count()
    return GraphMetrics(b["node_count"], b["edge_count"], b["average_degree"], b["density"], histogram, near, parts, paths["diameter"], paths["average_path_length"], paths["confidence"])
