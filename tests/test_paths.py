import pytest
from pyspark.sql import functions as F

from weftgraph.errors import GraphOperationError, NodeNotFoundError, PathValidationError
from weftgraph.graph import KGraph
from weftgraph.operators import paths as p

CYCLIC = [("A", "B"), ("B", "C"), ("C", "A"), ("A", "D"), ("C", "E"), ("D", "E")]


@pytest.fixture(scope="module")
def graph(spark):
    return KGraph.from_pairs(spark, CYCLIC)


def ways(df):
    return [r["nodes"] for r in df.collect()]


def test_shortest(graph):
    found = p.shortest_path(graph, "A", "E")
    assert found.nodes == ["A", "D", "E"] and (found.total_weight, found.length, len(found)) == (2.0, 2, 2)
    assert found[0]["dst"] == "D" and [e["src"] for e in found] == ["A", "D"]
    found.validate()


def test_shortest_to_itself_and_errors(graph, spark):
    same = p.shortest_path(graph, "A", "A")
    assert same.nodes == [] and same.total_weight == 0
    with pytest.raises(NodeNotFoundError, match="Start node 'x'"):
        p.shortest_path(graph, "x", "y")
    with pytest.raises(NodeNotFoundError, match="End node 'y'"):
        p.shortest_path(graph, "A", "y")
    with pytest.raises(GraphOperationError) as e:
        p.shortest_path(graph, "E", "A")
    assert str(e.value) == "Graph Operation Error: No path exists between E and A"
    zero = KGraph.from_pairs(spark, [("A", "B", "calls", 0.0)])
    with pytest.raises(ValueError, match="is not positive"):
        p.shortest_path(zero, "A", "B", weight=F.col("weight"))


def test_weights_and_ties(spark):
    g = KGraph.from_pairs(spark, [("S", "B", "calls", 1), ("S", "A", "calls", 1), ("A", "T", "calls", 2), ("B", "T", "calls", 2), ("S", "T", "calls", 9), ("S", "C", "calls", 2), ("C", "T", "calls", 1)])
    assert p.shortest_path(g, "S", "T").nodes == ["S", "T"]
    found = p.shortest_path(g, "S", "T", weight=F.col("weight"))
    assert found.nodes == ["S", "A", "T"] and found.total_weight == 3.0  # the nearer predecessor, then the lesser name


def test_a_long_cheap_way_beats_a_short_one(spark):
    g = KGraph.from_pairs(spark, [("A", "D", "calls", 10), ("A", "B", "calls", 1), ("B", "C", "calls", 1), ("C", "D", "calls", 1)])
    assert p.shortest_path(g, "A", "D", weight=F.col("weight")).nodes == ["A", "B", "C", "D"]


def test_all_paths(graph):
    assert ways(p.all_paths(graph, "A", "E")) == [["A", "B", "C", "E"], ["A", "D", "E"]]
    assert ways(p.all_paths(graph, "A", "E", max_length=2)) == [["A", "D", "E"]]
    assert ways(p.all_paths(graph, "A", "E", max_paths=1)) == [["A", "B", "C", "E"]]
    assert ways(p.all_paths(graph, "A", "E", max_paths=1, keep=F.size("edges") == 2)) == [["A", "D", "E"]]
    assert [r["length"] for r in p.all_paths(graph, "A", "A").collect()] == [0]
    assert ways(p.all_paths(graph, "E", "A")) == []
    for bad in ({"max_length": 0}, {"max_paths": -1}):
        with pytest.raises(ValueError, match="positive number"):
            p.all_paths(graph, "A", "E", **bad)


def test_facade(graph):
    assert p.find_paths(graph, "A", "E").nodes == ["A", "D", "E"]
    assert ways(p.find_paths(graph, "A", "E", p.ALL)) == ways(p.find_paths(graph, "A", "E", p.FILTERED))
    with pytest.raises(ValueError):
        p.find_paths(graph, "A", "E", "other")


def test_validation(spark):
    broken = p.PathResult([{"src": "A", "dst": "B"}, {"src": "C", "dst": "D"}], 2.0, 2)
    with pytest.raises(PathValidationError, match="edge 0 ends in B, but edge 1 begins in C"):
        broken.validate()
    with pytest.raises(PathValidationError, match="1 edges in a path of length 2"):
        p.PathResult([{"src": "A", "dst": "B"}], 1.0, 2).validate()
    df = spark.sql("select array(named_struct('src','A','dst','B'), named_struct('src','C','dst','D')) as e, 2 as n union all select array(named_struct('src','A','dst','B')), 1 union all select array(named_struct('src','A','dst','B')), 3")
    assert [r[0] for r in df.select(p.path_errors(F.col("e"), F.col("n"))).collect()] == ["edges do not join", None, "not as many edges as its length"]


def test_first_paths_of_a_grid(spark, monkeypatch):
    """Of a grid with more paths than could ever be made, the first ones in order; and by small waves the same as from all."""
    n, name = 8, lambda i, j: f"n{i:02d}_{j:02d}"
    g = KGraph.from_pairs(spark, [(name(i, j), name(*to)) for i in range(n) for j in range(n) for to in ((i + 1, j), (i, j + 1)) if max(to) < n])
    found = ways(p.all_paths(g, name(0, 0), name(n - 1, n - 1), max_paths=5))
    assert found[0] == [name(0, j) for j in range(n)] + [name(i, n - 1) for i in range(1, n)] and found == sorted(found) and len({tuple(w) for w in found}) == 5
    small = KGraph.from_pairs(spark, [(name(i, j), name(*to)) for i in range(4) for j in range(4) for to in ((i + 1, j), (i, j + 1)) if max(to) < 4])
    monkeypatch.setattr(p, "WAVE", 3)
    every = ways(p.simple_paths(small, name(0, 0), name(3, 3)))
    assert len(every) == 20 and ways(p.all_paths(small, name(0, 0), name(3, 3), max_paths=7)) == sorted(every)[:7]


def test_a_long_chain(spark):
    """Predecessors by doubled jumps: ways of several lengths."""
    g = KGraph.from_pairs(spark, [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(9)])
    for k in (1, 4, 9):
        assert p.shortest_path(g, "c00", f"c{k:02d}").nodes == [f"c{i:02d}" for i in range(k + 1)]
