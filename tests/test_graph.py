import pytest
from pyspark.sql import functions as F

from weftgraph.errors import EdgeNotFoundError, NodeNotFoundError
from weftgraph.graph import KGraph

BOTH = [("A", "B"), ("B", "C"), ("A", "C"), ("B", "A"), ("C", "B")]


def names(df, column="node"):
    return sorted(r[column] for r in df.collect())


@pytest.fixture
def graph(spark):
    return KGraph.from_pairs(spark, BOTH)


def test_lookups(graph):
    assert graph.edge_count() == 5 and names(graph.nodes()) == ["A", "B", "C"]
    assert names(graph.neighbors("A")) == ["B", "C"] and names(graph.neighbors("unknown")) == []
    assert {r["node"]: r["degree"] for r in graph.degrees().collect()} == {"A": 2, "B": 2, "C": 1}
    assert graph.degree("A") == 2 and graph.degree("unknown") == 0
    assert graph.edge("A", "B")["dst"] == "B" and graph.edge("C", "A") is None
    assert graph.has_node("A") and not graph.has_node("x") and graph.has_edge("A", "C") and not graph.has_edge("C", "A")


def test_checked_lookup_names_what_is_missing(graph):
    assert graph.edge_or_raise("A", "B")["src"] == "A"
    with pytest.raises(NodeNotFoundError, match="Source node 'x'"):
        graph.edge_or_raise("x", "y")
    with pytest.raises(NodeNotFoundError, match="Target node 'y'"):
        graph.edge_or_raise("A", "y")
    with pytest.raises(EdgeNotFoundError, match="'C' to 'A'"):
        graph.edge_or_raise("C", "A")


def test_last_edge_of_a_pair_wins(spark):
    g = KGraph.from_pairs(spark, [("A", "B", "calls", 1.0), ("A", "B", "imports", 2.0), ("A", "A")])
    assert g.edge_count() == 2 and g.edge("A", "B")["relation_type"] == "imports" and g.degree("A") == 2
    g.add_edge("A", "B", "extends", 3.0)
    assert g.edge_count() == 2 and g.edge("A", "B")["weight"] == 3.0


def test_edges_without_ends_are_left_out(spark):
    g = KGraph(spark.createDataFrame([("A", None), (None, "B"), ("A", "B")], "src string, dst string"))
    assert g.edge_count() == 1 and g.edge("A", "B")["weight"] == 1.0


def test_removal_keeps_the_ends(graph):
    graph.remove_edge("A", "C")
    assert graph.edge_count() == 4
    for src, dst in [("A", "B"), ("B", "A"), ("B", "C"), ("C", "B")]:
        graph.remove_edge(src, dst)
    assert graph.edge_count() == 0 and names(graph.nodes()) == ["A", "B", "C"] and graph.degree("A") == 0 and graph.has_node("A")
    with pytest.raises(EdgeNotFoundError):
        graph.remove_edge("A", "B")


def test_a_batch_is_all_or_nothing(spark, graph):
    for pairs in ([("A", "B"), ("x", "y")], [("A", "B"), ("A", "B")]):
        with pytest.raises(EdgeNotFoundError):
            graph.remove_edges(spark.createDataFrame(pairs, "src string, dst string"))
        assert graph.edge_count() == 5


def test_transactions_nest_and_roll_back(graph):
    with pytest.raises(RuntimeError), graph.transaction():
        graph.add_edge("C", "D")
        with graph.transaction():
            graph.add_edge("D", "E")
        assert graph.edge_count() == 7
        raise RuntimeError
    assert graph.edge_count() == 5 and not graph.has_node("D")
    with graph.transaction():
        graph.add_edge("C", "D")
    assert graph.has_edge("C", "D")


def test_paths_are_kept_until_a_change(graph):
    assert graph.find_paths("A", "C") == [["A", "B", "C"], ["A", "C"]]
    assert graph.find_paths("A", "C", max_depth=1) == [["A", "C"]]
    assert graph.find_paths("A", "A") == [["A"]] and graph.find_paths("A", "x") == []
    held = graph.cache_stats()["size"]
    assert graph.find_paths("A", "C") is graph.find_paths("A", "C") and graph.cache_stats()["size"] == held
    graph.remove_edge("A", "C")
    assert graph.cache_stats()["size"] == 0 and graph.find_paths("A", "C") == [["A", "B", "C"]]
    graph.clear_cache()


def test_isolated_nodes_on_request(spark):
    nodes = spark.createDataFrame([("A",), ("Z",)], "name string")
    edges = spark.createDataFrame([("A", "B")], "src string, dst string")
    assert names(KGraph(edges, nodes).nodes()) == ["A", "B"]
    assert names(KGraph(edges, nodes, include_isolated=True).nodes()) == ["A", "B", "Z"]


def test_empty_graph(spark):
    g = KGraph(spark.createDataFrame([], "src string, dst string"))
    assert g.edge_count() == 0 == g.node_count() and g.edges().where(F.lit(True)).collect() == []
