import json
import time
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftgraph import cli
from weftgraph.cache import ResultCache
from weftgraph.errors import ConflictError, DuplicateResourceError, EdgeNotFoundError, NodeNotFoundError, StorageError, ValidationError
from weftgraph.functions import scalar
from weftgraph.repository import EdgeRepository, NodeRepository
from weftgraph.schema import EDGE_DDL, NODE_DDL, with_edge_defaults, with_node_defaults
from weftgraph.sources.store import TABLES, Change, GraphStore, edge_json, from_json_rows, keyed_json, node_json, read_keyed_json, rows_from_json, write_keyed_json


def nodes_of(spark, *rows):
    return spark.createDataFrame([(n, t, d) for n, t, d in rows], "name string, entity_type string, dependencies array<string>")


def edges_of(spark, *rows):
    return spark.createDataFrame(list(rows), "from_entity string, relation_type string, to_entity string")


@pytest.fixture(params=["parquet", "json"])
def store(spark, tmp_path, request):
    return GraphStore(spark, str(tmp_path / "store"), request.param).initialize()


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_node_repository(spark, store):
    repo = NodeRepository(store, cache=ResultCache(10))
    repo.create(nodes_of(spark, ("a", "code_module", ["b"]), ("b", "dataset", ["c", "gone"]), ("c", "dataset", ["a"])))
    assert repo.get("a")["metadata"]["author"] == "system" and repo.get("a") is repo.get("a") and repo.exists("b") and not repo.exists("x")
    for bad in (nodes_of(spark, ("a", "dataset", [])), nodes_of(spark, ("n", "dataset", []), ("n", "dataset", []))):
        with pytest.raises(DuplicateResourceError):
            repo.create(bad)
    with pytest.raises(ValidationError, match="entity_type"):
        repo.create(nodes_of(spark, ("d", "nonsense", [])))
    with pytest.raises(NodeNotFoundError):
        repo.get("x")
    assert names(repo.with_dependencies("a")) == ["a", "b"] and names(repo.with_dependencies("a", transitive=True)) == ["a", "b", "c"]
    with pytest.raises(NodeNotFoundError):
        repo.with_dependencies("x")
    assert names(repo.by_type("dataset")) == ["b", "c"] and names(repo.list({"entity_type": "dataset"}, limit=1, offset=1)) == ["c"]
    with pytest.raises(ValidationError):
        repo.list(limit=0)
    repo.update(nodes_of(spark, ("a", "library", [])))
    assert repo.get("a")["entity_type"] == "library" and names(repo.list()) == ["a", "b", "c"]
    assert names(repo.get_or_create(nodes_of(spark, ("a", "dataset", []), ("e", "dataset", [])))) == ["a", "e"] and repo.get("a")["entity_type"] == "library"
    edges = EdgeRepository(store)
    edges.create(edges_of(spark, ("a", "calls", "b"), ("b", "calls", "c")))
    repo.delete(spark.createDataFrame([("a",)], "name string"))
    assert names(repo.list()) == ["b", "c", "e"] and edges.rows.count() == 1
    for change in (repo.update, repo.delete):
        with pytest.raises(NodeNotFoundError):
            change(nodes_of(spark, ("zz", "dataset", [])))


def test_edge_repository(spark, store):
    repo = EdgeRepository(store, validators=[lambda df: F.col("from_entity") != "bad"])
    repo.create(edges_of(spark, ("a", "calls", "b"), ("b", "calls", "c"), ("a", "imports", "b"), ("d", "calls", "d")))
    with pytest.raises(ValidationError, match="validator 0 failed"):
        repo.create(edges_of(spark, ("bad", "calls", "b")))
    ends = lambda df: sorted(r["from_entity"] + r["to_entity"] for r in df.collect())
    assert ends(repo.of_node("b")) == ["ab", "ab", "bc"] and ends(repo.of_node("b", "outgoing")) == ["bc"] and ends(repo.of_node("b", "incoming")) == ["ab", "ab"] and ends(repo.of_node("d")) == ["dd"]
    assert ends(repo.by_type("imports")) == ["ab"]
    assert [r["nodes"] for r in repo.find_paths("a", "c").collect()] == [["a", "b", "c"]]
    assert {(r["node"], r["component"]) for r in repo.connected_components().collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")}
    assert repo.neighborhood("a").count() == 1
    repo.delete(edges_of(spark, ("a", "imports", "b")))
    with pytest.raises(EdgeNotFoundError):
        repo.get("a", "imports", "b")


def test_backup_and_restore(spark, store, tmp_path):
    repo = NodeRepository(store)
    repo.create(nodes_of(spark, ("a", "dataset", [])))
    to = store.backup()
    assert "_backup_" in to
    repo.create(nodes_of(spark, ("b", "dataset", [])))
    for _ in range(2):  # the backup stays
        store.restore(to)
        assert names(repo.list()) == ["a"]
    store.cleanup()
    assert names(repo.list()) == ["a"]
    with pytest.raises(StorageError):
        store.restore(str(tmp_path / "nowhere"))
    with pytest.raises(StorageError):
        GraphStore(spark, "x", "csv")


def test_a_commit_that_breaks_off_keeps_the_old_table(spark, store, monkeypatch):
    from weftgraph.sources.commits import CommitLog

    repo = NodeRepository(store)
    repo.create(nodes_of(spark, ("a", "dataset", [])))
    monkeypatch.setattr(CommitLog, "add", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.write("nodes", store.read("nodes").where("false"))
    monkeypatch.undo()
    assert names(repo.list()) == ["a"] and names(NodeRepository(GraphStore(spark, store.path, store.format).initialize()).list()) == ["a"]
    store._delete(f"{store.path}/log")
    with pytest.raises(StorageError, match="no log"):
        store.initialize()


def test_a_cascade_is_one_commit(spark, store, monkeypatch):
    from weftgraph.sources.commits import CommitLog

    nodes, edges = NodeRepository(store), EdgeRepository(store)
    nodes.create(nodes_of(spark, *[(n, "dataset", []) for n in "abc"]))
    edges.create(edges_of(spark, ("a", "calls", "b"), ("b", "calls", "c"), ("c", "calls", "a"), ("a", "calls", "a")))
    monkeypatch.setattr(CommitLog, "add", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        nodes.delete(nodes_of(spark, ("a", "dataset", [])))
    monkeypatch.undo()
    assert names(nodes.list()) == ["a", "b", "c"] and edges.list().count() == 4
    nodes.delete(nodes_of(spark, ("a", "dataset", [])))
    assert names(nodes.list()) == ["b", "c"] and [(r["from_entity"], r["to_entity"]) for r in edges.list().collect()] == [("b", "c")]
    nodes.create(nodes_of(spark, ("a", "metric", [])))  # a name may come back
    assert nodes.get("a")["entity_type"] == "metric" and names(nodes.list()) == ["a", "b", "c"]
    nodes.delete(nodes_of(spark, ("b", "dataset", [])), cascade=False)
    assert edges.list().count() == 1


def test_two_writers(spark, store):
    """Of two changes made from one version, the second is refused; a repository then begins again; additions both hold."""
    first, second = NodeRepository(store), NodeRepository(GraphStore(spark, store.path, store.format))
    first.create(nodes_of(spark, ("a", "dataset", []), ("b", "dataset", [])))
    began = store.version()
    first.update(nodes_of(spark, ("a", "metric", [])))
    with pytest.raises(ConflictError, match="nodes"):
        second.store.write("nodes", second.rows.where("false"), began)
    second.store.commit({"edges": Change(rows=with_edge_defaults(edges_of(spark, ("a", "calls", "b"))))}, began)  # another table
    assert first.get("a")["entity_type"] == "metric" and store.read("edges").count() == 1

    late, taken = second.store.commit, []

    def commit(changes, began=None, stream=None):
        if not taken:
            taken.append(1)
            first.update(nodes_of(spark, ("b", "metric", ["a"])))
        return late(changes, began, stream)

    second.store.commit = commit
    second.update(nodes_of(spark, ("a", "insight", [])))
    assert {r["name"]: r["entity_type"] for r in first.list().collect()} == {"a": "insight", "b": "metric"}
    taken.clear()
    second.store.commit = lambda *a, **k: (taken.append(1), first.update(nodes_of(spark, ("b", "metric", []))), late(*a, **k))
    with pytest.raises(ConflictError):
        second.update(nodes_of(spark, ("a", "dataset", [])))
    assert len(taken) == 5 and first.get("a")["entity_type"] == "insight"


def test_a_change_writes_what_it_changes(spark, store):
    repo = NodeRepository(store)
    row = lambda ids: ids.select(F.concat(F.lit("node"), "id").alias("name"), F.lit("dataset").alias("entity_type"), F.sha2(F.col("id").cast("string"), 512).alias("documentation"))
    size = lambda: sum(f.stat().st_size for f in Path(store.path).rglob("part-*"))
    repo.create(row(spark.range(0, 20_000, 1, 2)))
    whole = size()
    repo.update(row(spark.range(0, 200, 1, 1)).withColumn("entity_type", F.lit("metric")))
    repo.delete(row(spark.range(1000, 1200, 1, 1)))
    assert size() - whole < 0.05 * whole
    counts = lambda: {r["entity_type"]: r["count"] for r in repo.list().groupBy("entity_type").count().collect()}
    assert counts() == {"dataset": 19_600, "metric": 200}
    store.compact("nodes")
    assert counts() == {"dataset": 19_600, "metric": 200} and len(store.log.state().tables["nodes"]) == 1
    store.cleanup()
    assert counts() == {"dataset": 19_600, "metric": 200} and size() < 1.1 * whole


def test_long_logs(spark, store):
    """Beyond the entries that one snapshot covers."""
    from weftgraph.sources.commits import SNAPSHOT_EVERY

    for _ in range(SNAPSHOT_EVERY + 5):
        store.claim_ids(2)
    state = store.log.state()
    assert state.next_id == 2 * (SNAPSHOT_EVERY + 5) and set(state.tables) == set(TABLES) and state.number == len(store.log.numbers()) - 1


def test_keyed_json_file(spark, tmp_path):
    path = str(tmp_path / "nodes.json")
    for rows in ([("b", "dataset", ["x"]), ('q"u', "metric", [])], [("a", "dataset", None)], []):
        df = with_node_defaults(spark.createDataFrame(rows, "name string, entity_type string, dependencies array<string>"))
        write_keyed_json(df.repartition(3), F.col("name"), path)
        assert sorted(json.loads((tmp_path / "nodes.json").read_text())) == sorted(r[0] for r in rows)
        assert names(read_keyed_json(spark, path, NODE_DDL)) == sorted(r[0] for r in rows)
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["nodes.json"]


NESTED = 'name string, note string, inner struct<a:int,list:array<struct<x:string>>>'


@pytest.mark.parametrize("indent", [None, 2])
def test_keyed_json_in_splits(spark, tmp_path, indent):
    """Braces, brackets, quotes and backslashes within texts; on one line and on many; splits smaller than a record."""
    notes = ["}", "{", '"', "\\", '\\"}', "]}[{", "a, b: c", "\n\t}", "é😀}", "", None, "x" * 3000 + "}{" * 50]
    rows = {f'k"}}{i}': {"name": f"n{i}", "note": notes[i % len(notes)], "inner": {"a": i, "list": [{"x": notes[(i + 1) % len(notes)]}, {"x": "}"}] if i % 3 else []}} for i in range(400)}
    (tmp_path / "k.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        back = read_keyed_json(spark, str(tmp_path / "k.json"), NESTED)
        assert spark.read.option("lineSep", "}").text(str(tmp_path / "k.json")).rdd.getNumPartitions() > 20
        got = {r["key"]: r.asDict(True) for r in back.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {k: {"key": k, **v} for k, v in rows.items()} and back.count() == 400
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_keyed_json(back.drop("key").repartition(3), F.col("name"), str(tmp_path / "folder"), one_file=False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [json.loads(f.read_text()) for f in (tmp_path / "folder").glob("part-*")]
    assert len(parts) > 1 and {k for p in parts for k in p} == {f"n{i}" for i in range(400)}
    assert sorted(r["name"] for r in read_keyed_json(spark, str(tmp_path / "folder"), NESTED).collect()) == sorted(f"n{i}" for i in range(400))


def test_scratch_tables_go(spark):
    from weftgraph.runtime import scratch, stored

    with scratch(spark):
        kept = stored(spark.range(3))
        assert kept.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound"):
        spark.read.parquet(kept.inputFiles()[0]).count()


def test_json_forms(spark, tmp_path):
    nodes = with_node_defaults(nodes_of(spark, ("a", "dataset", ["b"]), ("q\"uote", "metric", [])), now=F.lit(datetime(2024, 5, 1, 2, 3, 4)))
    assert sorted(map(str, from_json_rows(node_json(nodes), NODE_DDL).collect())) == sorted(map(str, nodes.collect()))
    assert "documentation" not in json.loads(node_json(nodes).first()["value"])
    edges = with_edge_defaults(edges_of(spark, ("a", "calls", "b:c")), now=F.lit(datetime(2024, 5, 1)))
    assert edge_json(edges).first()["key"] == "a:calls:b:c" and from_json_rows(edge_json(edges), EDGE_DDL).collect() == edges.collect()
    lines = [r["value"] for r in keyed_json(nodes, F.col("name")).collect()]
    (tmp_path / "n.json").write_text("{" + ", ".join(lines) + "}")
    (tmp_path / "blank.json").write_text("")
    back = read_keyed_json(spark, str(tmp_path / "n.json"), NODE_DDL)
    assert names(back) == ["a", 'q"uote'] and sorted(r["key"] for r in back.collect()) == ["a", 'q"uote']
    assert read_keyed_json(spark, str(tmp_path / "blank.json"), NODE_DDL).collect() == []


def test_cli(spark, tmp_path, capsys):
    run = lambda *a: cli.main(["--data", str(tmp_path / "d"), *a], spark)
    assert run("add", json.dumps({"nodes": [{"name": "a", "entity_type": "dataset"}], "edges": [{"from_entity": "a", "relation_type": "calls", "to_entity": "b"}]})) == 0
    (tmp_path / "d" / "more.json").write_text(json.dumps([{"name": "b", "entity_type": "metric"}]))
    assert run("add-nodes", "@more.json") == 0 and run("list") == 0
    listed = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [x.get("name") for x in listed] == ["a", "b", None] and listed[0]["metadata"]["source"] == "cli" and listed[2]["impact_score"] == 1.0
    assert run("add-nodes", "{broken") == 1 and run("add-nodes", "@none.json") == 1 and run("add-nodes", '{"name": "a", "entity_type": "dataset"}') == 1
    assert rows_from_json('{"a": 1}') == [{"a": 1}]


def test_scalar_functions(spark):
    nodes = with_node_defaults(nodes_of(spark, ("a", "dataset", ["b"]), ("c", "dataset", None)), now=F.lit(datetime(2024, 1, 1)))
    at = F.lit(datetime(2024, 2, 1))
    more = scalar.append_to(nodes, "dependencies", F.lit("b"), F.lit(True), at).collect()
    assert {r["name"]: (r["dependencies"], r["metadata"]["last_modified"]) for r in more} == {"a": (["b"], datetime(2024, 2, 1)), "c": (["b"], datetime(2024, 2, 1))}
    tagged = scalar.append_to(nodes, "tags", F.lit("t"), F.col("name") == "a", at).collect()
    assert {r["name"]: (r["metadata"]["tags"], r["metadata"]["last_modified"]) for r in tagged} == {"a": (["t"], datetime(2024, 1, 1)), "c": ([], datetime(2024, 1, 1))}
    with pytest.raises(Exception, match="non-empty"):
        scalar.append_to(nodes, "observations", F.lit(" "), F.lit(True), at).collect()
    assert scalar.with_status(nodes, "done", F.lit(True), at).first()["metadata"]["status"] == "done"
    with pytest.raises(ValueError):
        scalar.with_status(nodes, " ", F.lit(True))
    metric = nodes.select(scalar.with_custom_metric(F.col("metadata.metrics.custom_metrics"), "m", 0.5).alias("m")).first()["m"]
    assert metric["m"]["value"] == 0.5
    with pytest.raises(ValueError):
        scalar.with_custom_metric(F.col("x"), "m", 2.0)
    edges = with_edge_defaults(edges_of(spark, ("a", "calls", "b")))
    assert scalar.with_confidence(edges, 0.25, F.lit(True)).first()["metadata"]["confidence"] == 0.25
    assert scalar.with_validation_status(edges, "verified", F.lit(True)).first()["validation_status"] == "verified"
    for bad in (lambda: scalar.with_confidence(edges, 2, F.lit(True)), lambda: scalar.with_validation_status(edges, "x", F.lit(True))):
        with pytest.raises(ValueError):
            bad()
    iso = spark.sql("select timestamp_ntz'2024-01-02 03:04:05.060000' as t, timestamp_ntz'2024-01-02 03:04:05' as u")
    assert iso.select(scalar.iso_format(F.col("t")), scalar.iso_format(F.col("u"))).first()[:] == ("2024-01-02T03:04:05.060000", "2024-01-02T03:04:05")


def test_cache():
    c = ResultCache(2, ttl=0.2, encode=lambda v: v + 1, decode=lambda v: v - 1)
    c.put_many({"a": 1, "b": 2})
    assert c.get("a") == 1
    c.put("c", 3)  # b was used least recently
    assert c.get("b") is None and c.get_many(["a", "b", "c"]) == {"a": 1, "c": 3} and c.size() == 2
    assert c.delete("a") and not c.delete("a")
    time.sleep(0.25)
    assert c.cleanup_expired() == 1 and c.size() == 0 and c.stats()["capacity"] == 2
    with pytest.raises(ValueError):
        ResultCache(0)
