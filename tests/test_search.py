from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftgraph.errors import QueryError
from weftgraph.graph import KGraph
from weftgraph.operators import subgraphs as g
from weftgraph.schema import domain_of, name_of, value_of
from weftgraph.search.filters import Filter, Sort, contains_text, equal_fields, escaped
from weftgraph.search.query import GraphQuery, SearchQuery, SemanticEngine, SemanticQuery

ROWS = "name string, entity_type string, documentation string, observations array<string>, examples array<string>, embedding array<double>, metadata struct<created_at:timestamp_ntz,version:int,tags:array<string>,metrics:struct<confidence:double>>"


@pytest.fixture(scope="module")
def nodes(spark):
    at = lambda d: datetime(2024, 1, d)
    rows = [
        ("alpha", "code_module", "First (one)", ["fast"], [], [1.0, 0.0], (at(1), 1, ["x"], (0.9,))),
        ("beta", "dataset", None, ["Slow one"], ["e.g."], [0.6, 0.8], (at(2), 2, [], (0.5,))),
        ("gamma", "document", "a+b", None, [], [0.0, 0.0], (at(3), 3, None, (None,))),
        ("delta", "code_class", "", [], [], [-1.0, 0.0], (at(4), None, ["y", "z"], (0.7,))),
    ]
    return spark.createDataFrame(rows, ROWS)


def found(nodes, *filters):
    return sorted(r["name"] for r in nodes.where(SearchQuery(filters=list(filters)).condition(nodes)).collect())


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (Filter("name", "eq", "beta"), ["beta"]),
        (Filter("documentation", "eq", None), ["beta"]),
        (Filter("documentation", "ne", "a+b"), ["alpha", "beta", "delta"]),
        (Filter("metadata.version", "gt", 1), ["beta", "gamma"]),
        (Filter("metadata.version", "gte", 2), ["beta", "gamma"]),
        (Filter("metadata.version", "lt", 2), ["alpha"]),
        (Filter("metadata.version", "lte", 2), ["alpha", "beta"]),
        (Filter("metadata.version", "in", [1, None]), ["alpha", "delta"]),
        (Filter("metadata.version", "in", 3), ["gamma"]),
        (Filter("metadata.version", "nin", [1, 2]), ["delta", "gamma"]),
        (Filter("metadata.version", "nin", [1, None]), ["beta", "gamma"]),
        (Filter("observations", "contains", "SLOW"), ["beta"]),
        (Filter("name", "startswith", "AL"), ["alpha"]),
        (Filter("name", "endswith", "TA"), ["beta", "delta"]),
        (Filter("name", "regex", "^.e"), ["beta", "delta"]),
        (Filter("observations", "exists", False), ["gamma"]),
        (Filter("observations", "exists", True), ["alpha", "beta", "delta"]),
        (Filter("no.such", "exists", False), ["alpha", "beta", "delta", "gamma"]),
        (Filter("metadata.version", "type", "int"), ["alpha", "beta", "gamma"]),
        (Filter("metadata.version", "type", "string"), []),
        (Filter("embedding", "near", {"vector": [1.0, 0.0], "distance": 0.5}), ["alpha", "beta"]),
        (Filter("embedding", "near", [1.0, 0.0]), ["alpha", "beta", "gamma"]),
    ],
)
def test_filters(nodes, f, want):
    assert found(nodes, f) == want


def test_literal_text_and_storage_filters(nodes):
    assert [r["name"] for r in nodes.where(contains_text(nodes, "documentation", "A+B")).collect()] == ["gamma"]
    assert found(nodes, Filter("documentation", "contains", escaped("(one)"))) == ["alpha"]
    pick = lambda w: sorted(r["name"] for r in nodes.where(equal_fields(nodes, w)).collect())
    assert pick({"metadata.version": 1}) == ["alpha"] and pick({"missing": None}) == ["alpha", "beta", "delta", "gamma"]
    assert pick({"$or": [{"name": "beta"}, {"metadata.version": 3, "entity_type": "document"}], "name": "ignored"}) == ["beta", "gamma"]


def test_query_pages_sort_and_text(nodes):
    q = SearchQuery(sort=[Sort("metadata.version", "desc")], page=2, page_size=3, include_metadata=False)
    page = q.run(nodes)
    assert [r["name"] for r in page.rows.collect()] == ["delta"] and (page.total, page.total_pages) == (4, 2) and "metadata" not in page.rows.columns
    assert found(nodes) == ["alpha", "beta", "delta", "gamma"]
    run = lambda **o: sorted(r["name"] for r in SearchQuery(**o).run(nodes).rows.collect())
    assert run(query_text="ONE") == ["alpha", "beta"] and run(query_text="one", search_fields=["documentation"]) == ["alpha"]
    assert run(min_confidence=0.7) == ["alpha", "delta"]
    assert run(filters=[Filter("metadata.version", "gte", 1), Filter("metadata.version", "lte", 1)]) == ["alpha"]


@pytest.mark.parametrize(
    "q",
    [SearchQuery(page=0), SearchQuery(page_size=0), SearchQuery(min_confidence=2), SearchQuery(filters=[Filter("a", "like", 1)]), SearchQuery(sort=[Sort("a", "up")]), GraphQuery(max_depth=0), GraphQuery(traversal_strategy="x"), SemanticQuery(similarity_threshold=2), SemanticQuery(context_window=0), SemanticQuery(semantic_fields=[])],
)
def test_bad_queries(q):
    with pytest.raises(QueryError):
        q.validate()


def test_facets_histogram_suggestions(nodes):
    r = SearchQuery().run(nodes)
    assert {(x["field"], x["value"], x["count"]) for x in r.facets("metadata.version").collect()} == {("metadata.version", v, 1) for v in ("1", "2", "3", None)}
    assert [(x["bucket"], x["count"]) for x in r.histogram("metadata.created_at").collect()] == [(datetime(2024, 1, 1), 4)]
    assert r.average("metadata.metrics.confidence").first()[0] == pytest.approx(0.7)
    assert [x["suggestion"] for x in r.suggestions("AL").collect()] == ["alpha"]


def test_graph_query(spark, nodes):
    pick = lambda **o: sorted(r["name"] for r in GraphQuery(**o).run(nodes).rows.collect())
    assert pick(domain="code") == ["alpha", "delta"] and pick(entity_types=["dataset"]) == ["beta"]
    assert pick(time_range=(datetime(2024, 1, 2), datetime(2024, 1, 3))) == ["beta", "gamma"]
    graph = KGraph.from_pairs(spark, [("alpha", "beta", "calls"), ("beta", "gamma", "calls"), ("alpha", "delta", "imports")])
    out = GraphQuery(filters=[Filter("name", "eq", "alpha")], relation_types=["calls"], max_depth=1, include_connections=True, include_analysis=True, aggregate_nodes=True).traverse(nodes, graph)
    assert sorted(r["node"] for r in out["nodes"].collect()) == ["alpha", "beta"] and out["analysis"].edge_count == 1
    assert sorted(r["entity_type"] for r in out["aggregates"].collect()) == ["code_module", "dataset"]


def test_depth_first_graph_query(spark, nodes):
    """A node that the walk enters late may be too deep for what follows it, which a search in breadth reaches."""
    graph = KGraph.from_pairs(spark, [("alpha", "beta"), ("beta", "delta"), ("delta", "gamma"), ("alpha", "gamma"), ("gamma", "omega")])
    got = lambda s: {r["node"]: r["depth"] for r in GraphQuery(filters=[Filter("name", "eq", "alpha")], max_depth=3, traversal_strategy=s).traverse(nodes, graph)["nodes"].collect()}
    assert got("breadth_first") == {"alpha": 0, "beta": 1, "gamma": 1, "delta": 2, "omega": 2}
    assert got("depth_first") == {"alpha": 0, "beta": 1, "delta": 2, "gamma": 3}
    none = GraphQuery(filters=[Filter("name", "eq", "?")], traversal_strategy="depth_first").traverse(nodes, graph)
    assert none["nodes"].collect() == []


def test_semantic_extras(nodes):
    names = lambda q: [r["name"] for r in q.search(nodes, [1.0, 0.0]).rows.collect()]
    plain = names(SemanticQuery(similarity_threshold=0.5))
    assert plain == ["alpha", "beta"]
    old_first = nodes.withColumn("metadata", F.col("metadata").withField("last_modified", F.when(F.col("name") == "beta", F.lit(datetime(2024, 6, 1))).otherwise(F.lit(datetime(2020, 1, 1)))))
    found = SemanticQuery(similarity_threshold=0.5, boost_recent=True, recency_weight=5.0).search(old_first, [1.0, 0.0])
    assert [r["name"] for r in found.rows.collect()] == ["beta", "alpha"] and found.total == 2
    near = SemanticQuery(similarity_threshold=0.9, include_similar=True, similar_at=0.5).search(nodes, [1.0, 0.0]).rows.collect()
    assert {r["name"]: r["similar_to"] for r in near}["alpha"] is None and any(r["similar_to"] == "alpha" for r in near)
    concept = dict(similarity_threshold=0.0, filters=[Filter("name", "contains", "alph")], concepts={"alph": ["bet"]})
    assert names(SemanticQuery(**concept)) == ["alpha"] and names(SemanticQuery(semantic_operators=["concept_expansion"], **concept)) == ["alpha", "beta"]


def test_semantic(nodes):
    names = lambda q: [r["name"] for r in q.search(nodes, [1.0, 0.0]).rows.collect()]
    assert names(SemanticQuery(similarity_threshold=0.5)) == ["alpha", "beta"] and names(SemanticQuery(similarity_threshold=0.0)) == ["alpha", "beta", "gamma"]
    widen = dict(similarity_threshold=0.0, synonyms={"alpha": ["beta"]}, related_types={"dataset": ["document"]})
    assert names(SemanticQuery(filters=[Filter("name", "eq", "alpha")], semantic_operators=["expand_synonyms"], **widen)) == ["alpha", "beta"]
    assert names(SemanticQuery(filters=[Filter("entity_type", "eq", "dataset")], semantic_operators=["include_related", "unknown"], **widen)) == ["beta", "gamma"]
    assert names(SemanticQuery(filters=[Filter("name", "eq", "alpa")], semantic_operators=["fuzzy_match"], **widen)) == ["alpha"]


def test_semantic_engine_embeds(nodes):
    def embed(texts):
        return texts.map(lambda t: [float(t.count("a")), float(len(t))])

    engine = SemanticEngine(embed)
    got = engine.search(nodes.drop("embedding"), SemanticQuery(query_text="alpha", similarity_threshold=0.9, semantic_fields=["name"]))
    assert [r["name"] for r in got.rows.collect()][0] == "alpha"
    both = SemanticEngine({"default": embed, "other": lambda texts: texts.map(lambda t: [1.0, 0.0])})
    assert both.vector("alpha", "other") == [1.0, 0.0] != both.vector("alpha")
    with pytest.raises(QueryError):
        both.search(nodes.drop("embedding"), SemanticQuery(query_text="x", embedding_model="none"))
    with pytest.raises(QueryError):
        engine.search(nodes, SemanticQuery())


def test_subgraphs(spark):
    graph = KGraph.from_pairs(spark, [("A", "B"), ("A", "C", "calls"), ("B", "D"), ("B", "E", "calls"), ("E", "C")])
    types = spark.createDataFrame([(n, "code_module" if n in "ACE" else "code_function") for n in "ABCDE"], "name string, entity_type string")
    edges = lambda df: sorted(r["src"] + r["dst"] for r in df.collect())
    nodes = lambda df: "".join(sorted(r["node"] for r in df.collect()))
    assert [f(x) for f, x in zip((nodes, edges), g.neighborhood(graph, "A"), strict=True)] == ["ABC", ["AB", "AC"]]
    assert [f(x) for f, x in zip((nodes, edges), g.neighborhood(graph, "A", 2, lambda n: n != "B"), strict=True)] == ["ACDE", ["AC", "EC"]]
    assert [f(x) for f, x in zip((nodes, edges), g.neighborhood(graph, "A", 0), strict=True)] == ["A", []]
    assert edges(g.neighborhood(graph, "A", 2, edges_where=F.col("relation_type") == "calls")[1]) == ["AC", "BE"]
    for kinds, relations, want in ((["CODE_MODULE"], None, ["AC", "EC"]), (None, ["CALLS"], ["AC", "BE"]), (["code_module"], ["calls"], ["AC"]), (None, None, ["AB", "AC", "BD", "BE", "EC"]), (["NO_SUCH"], None, [])):
        assert edges(g.by_type(graph, types, kinds, relations)[1]) == want
    assert nodes(g.by_type(graph, types, ["CODE_MODULE"])[0]) == "ACE"


def test_names_and_domains(spark):
    assert name_of("specification") == "SPEC" and value_of("SPEC") == "specification" and value_of("CODE_MODULE") == "code_module"
    df = spark.createDataFrame([("metric",), ("nothing",), (None,)], "t string")
    assert [r[0] for r in df.select(domain_of(F.col("t"))).collect()] == ["analysis", None, None]
