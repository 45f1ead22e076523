"""All pairs of vectors by blocks, and the components that they make."""

import numpy as np
import pytest

from weftgraph.operators.components import component_sizes
from weftgraph.plans import views
from weftgraph.search import blocks


def vectors(kind, n=150):
    r = np.random.default_rng(5)
    x = r.normal(size=(n, 6))
    if kind == "clusters":
        x = r.normal(size=(6, 6))[r.integers(0, 6, n)] + 0.01 * r.normal(size=(n, 6))
    x[3], x[9] = x[2], 0
    return x.astype(np.float32)


def components_of(x, least):
    d = x.astype(float)
    size = np.linalg.norm(d, axis=1)
    ok = (d @ d.T) / np.maximum(np.outer(size, size), 1e-300) >= least
    np.fill_diagonal(ok, False)
    found = np.arange(len(x))
    for _ in range(len(x)):
        found = np.minimum(found, np.where(ok, found[None, :], len(x)).min(axis=1))
    return {(f"{i:08d}", f"{c:08d}") for i, c in enumerate(found) if ok[i].any()}


@pytest.mark.parametrize(("kind", "least", "loose"), [("any", 0.75, 8192), ("any", 0.9, 0), ("clusters", 0.99, 5)])
def test_components_without_edges(spark, tmp_path, monkeypatch, kind, least, loose):
    """Blocks by rounds, and with few vectors left a scan: no list of pairs is made, and none is dealt to each other block."""
    monkeypatch.setattr(views, "BLOCK", 16)
    monkeypatch.setattr(blocks, "LOOSE", loose)
    monkeypatch.setattr(views, "similar", None)
    x = vectors(kind)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = views.similar_components(spark, str(tmp_path), least)
    got, want = [tuple(r) for r in found.collect()], components_of(x, least)
    assert set(got) == want and len(got) == len(want)
    sizes = {r["component"]: r["size"] for r in component_sizes(found).collect()}
    assert sizes == {c: sum(1 for _, d in want if d == c) for _, c in want}


def test_pairs_leave_as_keys(spark, tmp_path, monkeypatch):
    """Vectors are not dealt once for each block that they meet: no group of a shuffle holds two blocks."""
    monkeypatch.setattr(views, "BLOCK", 16)
    x = vectors("any")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    edges = views.similar(spark, str(tmp_path), 0.8).edges()
    assert "FlatMapGroupsInArrow" not in edges._jdf.queryExecution().toString()
    d = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-300)
    want = {(f"{a:08d}", f"{b:08d}") for a, b in zip(*np.nonzero(np.triu(d @ d.T >= 0.8, 1)), strict=True)}
    got = [(r["src"], r["dst"]) for r in edges.collect()]
    assert set(got) == want and len(got) == len(want) and want


def test_names_that_rows_share(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0]), (4, [-1.0, -1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted(tuple(r) for r in views.similar_components(spark, str(tmp_path), 0.9).collect()) == [(f"{i:08d}", "00000001") for i in (1, 2, 3)]


def test_weak_components_make_no_pairs(spark, tmp_path, monkeypatch):
    from weftgraph.plans import catalog

    monkeypatch.setattr(views, "similar", None)
    x = vectors("any", 60)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {tuple(r) for r in catalog.queries()["weakly_connected_components"](spark, str(tmp_path)).collect()} == components_of(x, 0.4)


def test_pairs_of_an_index_are_not_dealt_for_each_block(spark, tmp_path):
    """Blocks meet where they are stored: in the plan no group of a shuffle holds two blocks, and cells that cannot hold a pair stay apart."""
    from weftgraph.search.vectors import VectorIndex

    x = vectors("clusters").astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x) if v.any()]
    index = VectorIndex.build(spark.createDataFrame(rows, "name long, embedding array<double>"), str(tmp_path / "v"), cells=5)
    found = index.pairs(0.99, 16)
    assert "FlatMapGroupsInArrow" not in found._jdf.queryExecution().toString()
    d = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    near = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(d @ d.T >= 0.99, 1)), strict=True) if 3 not in (a, b)}  # 3 is equal to 2
    got = {(r["a"], r["b"]): r["similarity"] for r in found.collect()}
    assert set(got) == near and all(abs(s - d[a] @ d[b]) < 1e-12 for (a, b), s in got.items())
