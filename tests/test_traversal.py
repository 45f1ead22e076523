import random

import pytest

from weftgraph.errors import NodeNotFoundError
from weftgraph.graph import KGraph
from weftgraph.operators import traversal as t

PAIRS = [("A", "B"), ("A", "C"), ("B", "D"), ("B", "E"), ("E", "C")]


@pytest.fixture(scope="module")
def graph(spark):
    return KGraph.from_pairs(spark, PAIRS)


def levels(df):
    return [(r["node"], r["depth"]) for r in t.emission_order(df).collect()]


def walk(df):
    return [(r["node"], r["depth"]) for r in df.orderBy("visit_order").collect()]


def test_bfs_levels_in_order(graph):
    assert levels(t.bfs(graph, "A")) == [("A", 0), ("B", 1), ("C", 1), ("D", 2), ("E", 2)]
    assert levels(t.bfs(graph, "A", max_depth=1)) == [("A", 0), ("B", 1), ("C", 1)]
    assert levels(t.bfs(graph, "A", max_depth=0)) == [("A", 0)]


def test_bfs_order_follows_the_parents(spark):
    g = KGraph.from_pairs(spark, [("S", "B"), ("S", "A"), ("A", "Z"), ("B", "C"), ("B", "Z")])
    assert [n for n, _ in levels(t.bfs(g, "S"))] == ["S", "A", "B", "Z", "C"]


def test_bfs_hides_and_dfs_prunes(graph):
    hidden = levels(t.bfs(graph, "A", emit=lambda n: n != "B"))
    assert hidden == [("A", 0), ("C", 1), ("D", 2), ("E", 2)]
    assert walk(t.dfs(graph, "A", prune=lambda n: n != "B")) == [("A", 0), ("C", 1)]
    assert levels(t.bfs(graph, "A", prune=lambda n: n != "B")) == [("A", 0), ("C", 1)]
    assert t.bfs(graph, "A", emit=lambda n: n != "A").collect() == [] == t.dfs(graph, "A", prune=lambda n: n != "A").collect()


def test_dfs_preorder(graph):
    assert walk(t.dfs(graph, "A")) == [("A", 0), ("B", 1), ("D", 2), ("E", 2), ("C", 3)]
    assert walk(t.dfs(graph, "D")) == [("D", 0)]


def test_depth_limited_dfs_depends_on_the_order(spark):
    """C is met first at the limit, behind B, and then not expanded although A leads to it directly."""
    g = KGraph.from_pairs(spark, [("A", "B"), ("B", "C"), ("A", "C"), ("C", "D")])
    assert walk(t.dfs(g, "A", max_depth=2)) == [("A", 0), ("B", 1), ("C", 2)]
    assert ("D", 2) in levels(t.bfs(g, "A", max_depth=2))


def test_cycles_and_self_loops(spark):
    g = KGraph.from_pairs(spark, [("A", "A"), ("A", "B"), ("B", "A")])
    assert levels(t.bfs(g, "A")) == [("A", 0), ("B", 1)] == walk(t.dfs(g, "A"))


def test_facade_and_errors(graph):
    assert levels(t.traverse(graph, "A")) == levels(t.bfs(graph, "A"))
    for kind in (t.ITERATIVE_DFS, t.RECURSIVE_DFS):
        assert walk(t.traverse(graph, "A", kind, 1)) == [("A", 0), ("B", 1), ("C", 1)]
    with pytest.raises(ValueError):
        t.traverse(graph, "A", "sideways")
    with pytest.raises(NodeNotFoundError, match="Start node 'x' not found in the graph"):
        t.bfs(graph, "x")


def test_several_seeds(spark, graph):
    found = t.expand(graph.edges(), spark.createDataFrame([("D",), ("E",)], "node string"))
    assert sorted((r["node"], r["depth"]) for r in found.collect()) == [("C", 1), ("D", 0), ("E", 0)]


def plain_preorder(pairs, start, limit=None):
    after, out = {}, []
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    stack, seen = [(start, 0)], set()
    while stack:
        node, depth = stack.pop()
        if node not in seen:
            seen.add(node)
            out.append((node, depth))
            if limit is None or depth < limit:
                stack += [(n, depth + 1) for n in sorted(after.get(node, ()), reverse=True)]
    return out


@pytest.mark.parametrize("shape", ["wide", "deep", "any"])
def test_preorder_of_trees_is_found_in_parallel(spark, shape, monkeypatch):
    """By the tour, so that no walk is made; siblings may fill several ranges, and depths may be limited."""
    r = random.Random(3)
    parent = {"wide": lambda i: 0, "deep": lambda i: max(0, i - r.randint(1, 30)), "any": lambda i: r.randrange(i)}[shape]
    pairs = [(f"n{parent(i)}", f"n{i}") for i in range(1, 300)] + [("n5", "n5"), ("n7", "n0"), ("other", "n3x")]
    g = KGraph.from_pairs(spark, pairs)
    monkeypatch.setattr(type(g.edges()), "mapInPandas", None)
    for start, limit in (("n0", None), ("n0", 2), ("n4", 3)):
        assert walk(t.dfs(g, start, limit)) == plain_preorder(pairs, start, limit)
    prune = lambda n: ~n.endswith("7")
    assert walk(t.dfs(g, "n0", prune=prune)) == plain_preorder([p for p in pairs if p[1][-1] != "7"], "n0")


def test_preorder_of_random_graphs(spark):
    r = random.Random(8)
    for n in (12, 40):
        pairs = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(2 * n)] + [("n0", "n1")]
        assert walk(t.dfs(KGraph.from_pairs(spark, pairs), "n0")) == plain_preorder(pairs, "n0")


@pytest.mark.parametrize("shape", ["halves", "wide", "deep"])
def test_preorder_of_trees_without_a_round_for_each_level(spark, shape, monkeypatch):
    """Leaves come off in layers and the rest jumps; nodes with very many children, other roots and cycles beside the tree, and ways
    too long to keep, which go by the tour."""
    r = random.Random(5)
    parent = {"halves": lambda i: i // 2, "wide": lambda i: 0 if i % 3 else r.randrange(i), "deep": lambda i: max(0, i - r.randint(1, 20))}[shape]
    pairs = [(f"n{parent(i)}", f"n{i}") for i in range(1, 150)] + [("other", "o1"), ("o1", "o2"), ("n9", "n9")]
    pairs += [("c1", "c2"), ("c2", "c3"), ("c3", "c1")] if shape == "deep" else []
    g = KGraph.from_pairs(spark, pairs).held()
    monkeypatch.setattr(t, "CORE", 30)
    monkeypatch.setattr(t, "LONGEST_WAY", 4 if shape == "deep" else 128)
    monkeypatch.setattr(type(g.edges()), "mapInPandas", None)
    rounds, expand = [], t.expand
    monkeypatch.setattr(t, "expand", lambda *a, **k: rounds.append(1) or expand(*a, **k))
    for start, limit in (("n0", None), ("n3", 3)):
        assert walk(t.dfs(g, start, limit)) == plain_preorder(pairs, start, limit)
    assert (not rounds) == (shape != "deep")


def test_preorder_with_several_ranges_of_siblings(spark):
    """Ranks of 240 and more take several bytes, and those of one node fill several ranges."""
    pairs = [("n0", f"n{i:05d}") for i in range(1, 1500)] + [(f"n{i:05d}", f"m{i:05d}") for i in range(1, 1500, 7)]
    found = t.shallow_preorder(KGraph.from_pairs(spark, pairs).edges(), "n0")
    assert walk(found) == plain_preorder(pairs, "n0")
    assert t.shallow_preorder(KGraph.from_pairs(spark, [("a", "b"), ("c", "b")]).edges(), "a") is None
