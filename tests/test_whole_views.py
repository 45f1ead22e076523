"""Queries over whole tables: what the slices of the same names leave out is in them."""

from collections import deque
from datetime import datetime, timedelta

import pytest

from weftgraph.plans import catalog, views


@pytest.fixture(scope="module")
def handed(spark, tmp_path_factory):
    """Events of all types over a week, and the links that they make."""
    start, users = datetime(2024, 1, 1), [1, 2, 3, 1, 4, 5, 4, 6, 2, 7, 5, 8]
    rows = [(i, start + timedelta(hours=40 * (i // 3), minutes=i), u, ("error", "click", "view")[i % 3], 1.0, "{}") for i, u in enumerate(users)]
    at = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{at}/events.parquet")
    links = {(f"U{a[2]}", f"U{b[2]}") for a, b in zip(rows, rows[1:], strict=False) if a[1].date() == b[1].date()}
    return at, links


def distances(links):
    after, found = {}, {}
    for a, b in links:
        after.setdefault(a, set()).add(b)
    for s in {x for link in links for x in link}:
        found[s, s], todo = 0, deque([s])
        while todo:
            x = todo.popleft()
            for y in after.get(x, ()):
                if (s, y) not in found:
                    found[s, y] = found[s, x] + 1
                    todo.append(y)
    return found


def test_handoffs_of_all_events(spark, handed):
    at, links = handed
    run = lambda name: catalog.queries()[name](spark, at).collect()
    assert {(r["src"], r["dst"]) for r in run("graph_edges_dedup")} == links
    far, nodes = distances(links), {x for link in links for x in link}
    assert {(r["node"], r["component"]) for r in run("strongly_connected_components")} == {(x, min(y for y in nodes if (x, y) in far and (y, x) in far)) for x in nodes}
    [row] = run("path_metrics_exact")
    steps = [d for (a, b), d in far.items() if a != b]
    assert row["sample_size"] == len(nodes) and abs(row["average_path_length"] - sum(steps) / len(steps)) < 1e-6
    assert row["diameter"] == (max(steps) if len(steps) == len(nodes) * (len(nodes) - 1) else None)
    start = min(nodes)
    assert {r["node"] for r in run("dfs_preorder")} == {b for a, b in far if a == start}
    [row] = run("graph_metrics_all")
    assert (row["node_count"], row["edge_count"]) == (len(nodes), len(links))


def test_similar_vectors_of_all_labels(spark, tmp_path, monkeypatch):
    import numpy as np

    monkeypatch.setattr(views, "BLOCK", 7)  # several blocks
    x = np.random.default_rng(3).normal(size=(40, 4)).round(2)
    x[5], x[6] = x[4], 0
    spark.createDataFrame([(i, [float(c) for c in v], i % 5) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    x = x.astype(np.float32).astype(float)
    size = np.linalg.norm(x, axis=1)
    want = {(f"{a:08d}", f"{b:08d}") for a in range(40) for b in range(a + 1, 40) if size[a] * size[b] and x[a] @ x[b] / (size[a] * size[b]) >= 0.8}
    found = [(r["src"], r["dst"]) for r in views.similar(spark, str(tmp_path), 0.8).edges().collect()]
    assert set(found) == want and len(found) == len(want) and any(int(a) % 5 != int(b) % 5 for a, b in want)


def test_trade_of_all_orders(spark, small, tmp_path):
    """An order outside the first week makes a link, also in entry()."""
    from pyspark.sql import functions as F

    import __spark_entry__ as entry

    read = lambda name: spark.read.parquet(f"{small}/{name}.parquet")
    sold = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    want = {(f"N{r[0]}", f"N{r[1]}") for r in sold.select("s_nationkey", "c_nationkey").distinct().collect()}
    assert {(r["src"], r["dst"]) for r in views.trade(spark, small).edges().collect()} == want
    assert sum(r["degree"] for r in entry.entry(spark).collect()) == len(want)
