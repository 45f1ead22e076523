import random

import pytest

from weftgraph.graph import KGraph
from weftgraph.operators import components as c
from weftgraph.operators import metrics as m

TRIANGLE = [("A", "B"), ("B", "A"), ("B", "C"), ("C", "B"), ("C", "A"), ("A", "C")]


def sets(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["component"], set()).add(r["node"])
    assert all(k == min(v) for k, v in out.items())
    return sorted("".join(sorted(v)) for v in out.values())


def graph(spark, pairs):
    return KGraph(spark.createDataFrame([], "src string, dst string")) if not pairs else KGraph.from_pairs(spark, pairs)


@pytest.mark.parametrize(
    ("pairs", "weak", "strong"),
    [
        ([("A", "B"), ("B", "C"), ("D", "E")], ["ABC", "DE"], ["A", "B", "C", "D", "E"]),
        ([("A", "B"), ("B", "C"), ("C", "A"), ("D", "E"), ("E", "F"), ("F", "D"), ("G", "H")], ["ABC", "DEF", "GH"], ["ABC", "DEF", "G", "H"]),
        ([("A", "B"), ("B", "C"), ("C", "A"), ("C", "E"), ("E", "D"), ("D", "B")], ["ABCDE"], ["ABCDE"]),
        ([("A", "A")], ["A"], ["A"]),
        ([], [], []),
    ],
)
def test_components(spark, pairs, weak, strong):
    g = graph(spark, pairs)
    assert sets(c.weak_components(g)) == weak and sets(c.strong_components(g)) == strong


def test_components_of_a_random_graph(spark):
    r = random.Random(8)
    pairs = list({(f"n{r.randrange(40):02}", f"n{r.randrange(40):02}") for _ in range(55)})
    reach = {n: {n} for p in pairs for n in p}
    for _ in range(40):
        for a, b in pairs:
            reach[a] |= reach[b]
    for _ in range(7):
        for a in reach:
            for b in list(reach[a]):
                reach[a] |= reach[b]
    want = {n: min(x for x in reach[n] if n in reach[x]) for n in reach}
    assert {x["node"]: x["component"] for x in c.strong_components(graph(spark, pairs)).collect()} == want


def test_a_long_chain_and_a_hub(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)]
    hub = [("hub", f"leaf{i}") for i in range(60)]
    found = c.component_sizes(c.weak_components(graph(spark, chain + hub))).collect()
    assert sorted((x["component"], x["size"]) for x in found) == [("c000", 71), ("hub", 61)]


@pytest.mark.parametrize(
    ("pairs", "node", "value"),
    [
        ([("A", "B"), ("B", "A"), ("A", "C"), ("C", "A"), ("A", "D"), ("D", "A"), ("B", "C"), ("C", "B")], "A", 1 / 3),
        ([("A", "B"), ("B", "A"), ("A", "C"), ("C", "B")], "A", 0.5),
        (TRIANGLE, "B", 1.0),
        ([("A", "B"), ("A", "A")], "A", 0.0),
    ],
)
def test_clustering(spark, pairs, node, value):
    assert {r["node"]: r["coefficient"] for r in c.clustering(graph(spark, pairs)).collect()}[node] == pytest.approx(value)


def test_clustering_of_a_random_graph(spark):
    r = random.Random(5)
    pairs = {(f"n{r.randrange(15)}", f"n{r.randrange(15)}") for _ in range(80)}
    want = {}
    for n in {x for p in pairs for x in p}:
        near = {b for a, b in pairs if a == n} | {a for a, b in pairs if b == n}
        near -= {n}
        k = len(near)
        want[n] = sum((a, b) in pairs for a in near for b in near if a != b) / (k * (k - 1)) if k > 1 else 0.0
    assert {x["node"]: pytest.approx(x["coefficient"]) for x in c.clustering(graph(spark, list(pairs))).collect()} == want


@pytest.mark.parametrize(
    ("pairs", "n", "e", "degree", "density", "clustering", "parts", "diameter", "length"),
    [
        (TRIANGLE, 3, 6, 4.0, 1.0, 1.0, 1, 1, 1.0),
        ([("A", "B"), ("B", "C"), ("C", "D")], 4, 3, 1.5, 0.25, 0.0, 1, None, 5 / 3),
        ([("A", "B"), ("C", "D")], 4, 2, 1.0, 1 / 6, 0.0, 2, None, 1.0),
        ([("A", f"Node{i}") for i in range(5)], 6, 5, 5 / 3, 1 / 6, 0.0, 1, None, 1.0),
        ([("A", "A")], 1, 1, 2.0, 1.0, 0.0, 1, 0, 0.0),
        ([], 0, 0, 0.0, 0.0, 0.0, 0, None, 0.0),
    ],
)
def test_metrics(spark, pairs, n, e, degree, density, clustering, parts, diameter, length):
    x = m.calculate(graph(spark, pairs))
    assert (x.node_count, x.edge_count, x.connected_components, x.diameter) == (n, e, parts, diameter)
    assert (x.average_degree, x.density, x.clustering_coefficient, x.average_path_length) == pytest.approx((degree, density, clustering, length))
    assert sum(x.degree_distribution.values()) == n


def test_centrality(spark):
    g = graph(spark, [("A", "B"), ("A", "C"), ("B", "C")])
    assert {r["node"]: r["centrality"] for r in m.degree_centrality(g).collect()} == {"A": 1.0, "B": 0.5, "C": 0.0}
    assert m.degree_centrality(graph(spark, [("A", "A")])).first()["centrality"] == 0.0


def test_samples_are_repeatable_and_bounded(spark):
    """Above the thresholds metrics come from samples; a grid has no clustering and one component."""
    g = graph(spark, [(f"n{i}_{j}", f"n{i + a}_{j + b}") for i in range(6) for j in range(6) for a, b in ((0, 1), (1, 0)) if i + a < 6 and j + b < 6]).persist()
    one, two = (m.path_metrics_sampled(g, size=10, seed=1).first() for _ in range(2))
    assert one == two and one["sample_size"] == 10 and one["diameter"] == int(one["observed_diameter"] * 1.5) and one["confidence"] <= 1
    x = m.calculate(g, exact_paths_below=10, exact_clustering_below=10)
    assert (x.node_count, x.edge_count, x.clustering_coefficient, x.connected_components) == (36, 60, 0.0, 1) and x.diameter >= 10
    assert m.sample_size(2500) == 100 and m.sample_size(250_000) == 500 and m.sample_size(7) == 7
    assert m.path_metrics_sampled(graph(spark, [("A", "A")]), size=1).first()["confidence"] == 0.0


def test_distances_of_many_sources_at_once(spark):
    """Words of 64 sources against a row for each pair, on 150 nodes in several parts; the same for a sample."""
    r = random.Random(2)
    pairs = [(f"n{r.randrange(150)}", f"n{r.randrange(150)}") for _ in range(330)] + [(f"c{i}", f"c{i + 1}") for i in range(20)]
    g = graph(spark, pairs).persist()
    for sources in (None, m.sample_nodes(g, 70, 4)):
        want = {}
        for x in m.pair_distances(g, sources).collect():
            want[x["depth"]] = want.get(x["depth"], 0) + 1
        assert {x["depth"]: x["pairs"] for x in m.distance_counts(g, sources).collect()} == want
    depths = [x["depth"] for x in m.pair_distances(g, m.sample_nodes(g, 70, 4)).collect()]
    x = m.path_metrics_sampled(g, size=70, seed=4).first()
    mean = sum(depths) / len(depths)
    error = (sum((d - mean) ** 2 for d in depths) / (len(depths) - 1) / len(depths)) ** 0.5
    assert (x["average_path_length"], x["confidence"], x["observed_diameter"]) == pytest.approx((mean, 1 - 2 * error, max(depths)))


def test_clustering_of_a_sample(spark):
    r = random.Random(6)
    g = graph(spark, [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(220)] + [("x", "n1"), ("y", "y")]).persist()
    whole = {tuple(x) for x in c.clustering(g).collect()}
    nodes = m.sample_nodes(g, 15, 1).union(spark.createDataFrame([("x",), ("y",)], "node string"))
    names = {x["node"] for x in nodes.collect()}
    assert {tuple(x) for x in c.clustering_of(g, nodes).collect()} == {x for x in whole if x[0] in names}


@pytest.mark.parametrize("limits", [{"BATCH_WORDS": 1, "WIDE": 3}, {"HELD_EDGES": 10, "BATCH_ROWS": 150}])
def test_distances_by_batches_of_sources(spark, limits, monkeypatch):
    """One word of sources at a time, in a worker's memory with nodes of many edges in pieces, or by joins that leave no files."""
    from weftgraph import runtime

    r = random.Random(4)
    pairs = [(f"n{r.randrange(90)}", f"n{r.randrange(90)}") for _ in range(150)] + [(f"n{i}", "n0") for i in range(60)] + [(f"c{i}", f"c{i + 1}") for i in range(8)]
    g, after, want = graph(spark, pairs).held(), {}, {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    for start in {x for pair in pairs for x in pair}:
        seen, level, depth = {start}, {start}, 0
        while level := {y for x in level for y in after.get(x, ())} - seen:
            depth += 1
            seen |= level
            want[depth] = want.get(depth, 0) + len(level)
    for name, value in limits.items():
        monkeypatch.setattr(m, name, value)
    made, write = [], runtime.written
    monkeypatch.setattr(runtime, "written", lambda *a: made.append(write(*a)) or made[-1])
    assert {x["depth"]: x["pairs"] for x in m.distance_counts(g).collect()} == want
    assert made and not any(runtime._file(spark, path)[0].exists(runtime._file(spark, path)[1]) for path in made)
