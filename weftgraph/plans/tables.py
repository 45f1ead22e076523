"""Registered queries over stores, repositories and the event bus: written, changed, and read back."""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cache import ResultCache
from ..errors import EdgeNotFoundError, EngineError, GraphOperationError, NodeNotFoundError
from ..graph import KGraph
from ..operators import paths
from ..repository import EdgeRepository, NodeRepository
from ..runtime import checkpointed, remove, shared_dir
from ..schema import EDGE_DDL, NODE_DDL, with_edge_defaults
from ..search.filters import Filter, Sort
from ..search.query import GraphQuery, SearchQuery, SemanticQuery
from ..sources.store import GraphStore, edge_json, from_json_rows, node_json, read_keyed_json, write_keyed_json
from ..streaming import events as ev
from ..streaming.bus import EventBus
from ..tools import Tools
from . import views as v
from .registry import query
from .views import HANDOFF_SQL, ORDER_NODES_SQL, PLACES_SQL, TRADE_SQL, table


def _path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


def _store(spark: SparkSession, format: str = "parquet") -> GraphStore:
    return GraphStore(spark, _path(spark), format).initialize()


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as valid nodes: versions from 1."""
    nodes = v.order_nodes(spark, sf_dir)
    return nodes.withColumn("metadata", F.col("metadata").withField("version", F.col("metadata.version") + 1))


def _node_repository(spark: SparkSession, sf_dir: str, format: str = "parquet", **options) -> NodeRepository:
    repo = NodeRepository(_store(spark, format), **options)
    repo.create(_nodes(spark, sf_dir))
    return repo


def _edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("from_entity"), "relation_type", F.col("dst").alias("to_entity"))


def _edge_repository(spark: SparkSession, edges: DataFrame, store: GraphStore | None = None) -> EdgeRepository:
    repo = EdgeRepository(store or _store(spark))
    repo.create(_edges(edges))
    return repo


def _number() -> Column:
    return F.substring("name", 2, 20).cast("long")


# stores


@query(f"WITH {ORDER_NODES_SQL} SELECT name, entity_type, author, version + 1 AS version, obs1 || '|' || obs2 AS observations, dependency, confidence, total FROM nodes")
def store_nodes(spark, sf_dir):
    rows = _node_repository(spark, sf_dir).rows
    return rows.select("name", "entity_type", "metadata.author", "metadata.version", F.array_join("observations", "|").alias("observations"), F.col("dependencies")[0].alias("dependency"), F.col("metadata.metrics.confidence").alias("confidence"), F.col("metrics")["total"].alias("total"))


@query(f"WITH {HANDOFF_SQL} SELECT src, dst, relation_type, CAST(1 AS DOUBLE) AS confidence, 'unverified' AS validation_status FROM e")
def store_edges_as_json(spark, sf_dir):
    repo = _edge_repository(spark, v.handoff(spark, sf_dir).edges(), _store(spark, "json"))
    back = from_json_rows(edge_json(repo.rows), EDGE_DDL)
    return back.select(F.col("from_entity").alias("src"), F.col("to_entity").alias("dst"), "relation_type", F.col("metadata.confidence").alias("confidence"), "validation_status")


@query(f"""WITH {HANDOFF_SQL}, k AS (SELECT src, dst, relation_type, CAST(substr(src, 2) AS BIGINT) % 4 AS part FROM e)
SELECT src, dst, relation_type, CASE WHEN part = 1 THEN 'verified' ELSE 'unverified' END AS validation_status, part = 1 AS touched FROM k WHERE part <> 2""")
def edge_repository_changes(spark, sf_dir):
    """Stored hand-offs: a quarter updated, a quarter deleted, and one got by its key after each; deleting it again is refused."""
    repo = _edge_repository(spark, v.handoff(spark, sf_dir).edges())
    part = F.substring("from_entity", 2, 20).cast("long") % 4
    first = repo.rows.where(part == 1).orderBy(*repo.key).first()
    gone = checkpointed(repo.rows.where(part == 2).select(*repo.key))
    repo.update(repo.rows.where(part == 1).withColumn("validation_status", F.lit("verified")))
    repo.delete(gone)
    if first and repo.get(*[first[k] for k in repo.key])["validation_status"] != "verified":
        raise EngineError("an update was lost")
    if (one := gone.first()) and repo.exists(*one):
        raise EngineError("a deleted edge is still there")
    touched = F.col("metadata.last_modified") > F.col("metadata.created_at")
    return repo.rows.select(F.col("from_entity").alias("src"), F.col("to_entity").alias("dst"), "relation_type", "validation_status", touched.alias("touched"))


@query(f"WITH {HANDOFF_SQL} SELECT src, dst, relation_type FROM e")
def store_default_backup(spark, sf_dir):
    """The hand-offs of a store that was backed up under the name made from its own and the time, lost and restored."""
    repo = _edge_repository(spark, v.handoff(spark, sf_dir).edges())
    to = repo.store.backup()
    if not re.fullmatch(re.escape(repo.store.path) + r"_backup_[0-9_]+", to):
        raise EngineError(f"a backup of another name: {to}")
    repo.delete(repo.rows)
    repo.store.restore(to)
    return repo.rows.select(F.col("from_entity").alias("src"), F.col("to_entity").alias("dst"), "relation_type")


@query(f"WITH {ORDER_NODES_SQL} SELECT name AS key, name, entity_type, created_at FROM nodes")
def keyed_json_folder(spark, sf_dir):
    """All nodes by name as a folder of JSON objects, written and read in parts."""
    path = f"{_path(spark)}.json"
    write_keyed_json(_nodes(spark, sf_dir), F.col("name"), path, one_file=False)
    return read_keyed_json(spark, path, NODE_DDL).select("key", "name", "entity_type", F.col("metadata.created_at").alias("created_at"))


@query(f"WITH {ORDER_NODES_SQL} SELECT name AS key, name, entity_type, created_at FROM nodes")
def keyed_json_file(spark, sf_dir):
    """One JSON object of all nodes by name, written and read again."""
    path = f"{_path(spark)}.json"
    write_keyed_json(_nodes(spark, sf_dir), F.col("name"), path)
    return read_keyed_json(spark, path, NODE_DDL).select("key", "name", "entity_type", F.col("metadata.created_at").alias("created_at"))


@query(f"WITH {ORDER_NODES_SQL} SELECT name, NOT contains(entity_type, '?') AS same FROM nodes")
def node_json_rows(spark, sf_dir):
    """Nodes as JSON texts by name; each gives its row again."""
    nodes = _nodes(spark, sf_dir)
    back = from_json_rows(node_json(nodes), NODE_DDL).select("name", F.to_json(F.struct("*")).alias("again"))
    return nodes.select("name", F.to_json(F.struct("*")).alias("was")).join(back, "name").select("name", (F.col("was") == F.col("again")).alias("same"))


@query(f"WITH {ORDER_NODES_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE entity_type = 'dataset') AS d FROM nodes) SELECT 'before' AS stage, n AS nodes FROM c UNION ALL SELECT 'changed', n - d FROM c UNION ALL SELECT 'restored', n FROM c UNION ALL SELECT 'again', n FROM c")
def store_backup_restore(spark, sf_dir):
    repo = _node_repository(spark, sf_dir)
    counts, backup = [("before", repo.rows.count())], repo.store.backup(f"{repo.store.path}-backup")
    repo.delete(repo.list({"entity_type": "dataset"}))
    counts.append(("changed", repo.rows.count()))
    for stage in ("restored", "again"):
        repo.store.restore(backup)
        counts.append((stage, repo.rows.count()))
    repo.store.cleanup()
    return spark.createDataFrame(counts, "stage string, nodes long")


@query("SELECT 'nodes' AS name, count(*) AS rows FROM nation UNION ALL SELECT 'edges', count(*) FROM nation")
def cli_add_and_list(spark, sf_dir):
    """Nations as nodes, with edges to their regions, by the command line's JSON form; what it lists."""
    import contextlib
    import io

    from .. import cli

    nations = table(spark, sf_dir, "nation").select("n_name", "n_regionkey").collect()  # 25 rows
    given = {"nodes": [{"name": r["n_name"], "entity_type": "dataset"} for r in nations], "edges": [{"from_entity": r["n_name"], "relation_type": "composed_of", "to_entity": f"R{r['n_regionkey']}"} for r in nations]}
    at, out = _path(spark), io.StringIO()
    with contextlib.redirect_stdout(out):
        codes = [cli.main(["--data", at, *args], spark) for args in (["add", json.dumps(given)], ["list"])]
    listed = [json.loads(x) for x in out.getvalue().splitlines() if x.startswith("{")]
    n = sum("name" in x for x in listed)
    return spark.createDataFrame([("nodes", n), ("edges", len(listed) - n)] if codes == [0, 0] else [], "name string, rows long")


@query(f"WITH {ORDER_NODES_SQL}, s AS (SELECT name, entity_type FROM nodes WHERE entity_type = 'dataset' ORDER BY name LIMIT 20) SELECT 'get_nodes' AS tool, name, entity_type FROM s UNION ALL SELECT 'create_nodes', 'X', 'metric' UNION ALL SELECT 'update_nodes', 'X', 'insight'")
def tool_calls(spark, sf_dir):
    tools = Tools(_node_repository(spark, sf_dir).store)
    rows = [("get_nodes", x["name"], x["entity_type"]) for x in map(json.loads, tools.call("get_nodes", {"filters": {"entity_type": "dataset"}, "limit": 20}))]
    for tool, kind in (("create_nodes", "metric"), ("update_nodes", "insight")):
        list(tools.call(tool, {"nodes": [{"name": "X", "entity_type": kind}]}))
        rows += [(tool, x["name"], x["entity_type"]) for x in map(json.loads, tools.call("get_nodes", {"filters": {"name": "X"}}))]
    return spark.createDataFrame(rows, "tool string, name string, entity_type string")


# repositories


@query(f"WITH {ORDER_NODES_SQL} SELECT name FROM nodes WHERE entity_type = 'dataset' AND author = 'a3' ORDER BY name LIMIT 50 OFFSET 20")
def repository_list_page(spark, sf_dir):
    return _node_repository(spark, sf_dir).list({"entity_type": "dataset", "metadata.author": "a3"}, limit=50, offset=20).select("name")


@query(f"WITH {ORDER_NODES_SQL}, d AS (SELECT name FROM nodes WHERE entity_type = 'dataset' ORDER BY name LIMIT 100), s AS (SELECT name, dependency FROM nodes ORDER BY k DESC LIMIT 1) SELECT 'by_type' AS part, name FROM d UNION ALL SELECT 'dependencies', name FROM s UNION ALL SELECT 'dependencies', dependency FROM s")
def repository_by_type(spark, sf_dir):
    repo = _node_repository(spark, sf_dir)
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return repo.by_type("dataset", limit=100).select(F.lit("by_type").alias("part"), "name").union(repo.with_dependencies(f"O{last}").select(F.lit("dependencies").alias("part"), "name"))


@query(f"WITH {ORDER_NODES_SQL} SELECT name, CASE WHEN k % 3 = 0 THEN 'metric' ELSE entity_type END AS entity_type, CASE WHEN k % 3 = 0 THEN 9 ELSE version + 1 END AS version FROM nodes")
def repository_update(spark, sf_dir):
    repo = _node_repository(spark, sf_dir)
    changed = repo.rows.where(_number() % 3 == 0).withColumns({"entity_type": F.lit("metric"), "metadata": F.col("metadata").withField("version", F.lit(9))})
    repo.update(checkpointed(changed))
    return repo.rows.select("name", "entity_type", "metadata.version")


@query("SELECT 'nodes' AS name, count(*) AS rows FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT 'edges', count(*) FROM orders WHERE o_orderkey > 0 AND o_orderkey % 7 <> 0 AND (o_orderkey // 2) % 7 <> 0")
def repository_delete_cascade(spark, sf_dir):
    repo = _node_repository(spark, sf_dir)
    edges = _edge_repository(spark, v.halves(spark, sf_dir).edges(), repo.store)
    repo.delete(checkpointed(repo.rows.where(_number() % 7 == 0).select("name")))
    return spark.createDataFrame([("nodes", repo.rows.count()), ("edges", edges.rows.count())], "name string, rows long")


@query(f"WITH {ORDER_NODES_SQL} SELECT name, entity_type, 'old' AS was FROM nodes WHERE k % 5 = 0 UNION ALL SELECT 'new' || name, 'metric', 'new' FROM nodes WHERE k % 5 = 0")
def repository_get_or_create(spark, sf_dir):
    repo = _node_repository(spark, sf_dir)
    some = repo.rows.where(_number() % 5 == 0).select("name")
    asked = checkpointed(some.union(some.select(F.concat(F.lit("new"), "name"))).select("name", F.lit("metric").alias("entity_type")))
    return repo.get_or_create(asked).select("name", "entity_type", F.when(F.startswith("name", F.lit("new")), "new").otherwise("old").alias("was"))


@query("SELECT 'O1' AS name, true AS there, 1 AS hits UNION ALL SELECT 'O' || max(o_orderkey), true, 1 FROM orders UNION ALL SELECT 'O-1', false, 0")
def repository_get_cached(spark, sf_dir):
    """Single nodes: whether they are there, and how often the second look is answered by the cache."""
    repo = _node_repository(spark, sf_dir, cache=ResultCache())
    last, rows = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0], []
    for name in ("O1", f"O{last}", "O-1"):
        before = repo.cache.stats()["hits"]
        for _ in range(2):
            try:
                assert repo.get(name)["name"] == name
            except NodeNotFoundError:
                continue
        rows.append((name, repo.exists(name), repo.cache.stats()["hits"] - before))
    return spark.createDataFrame(rows, "name string, there boolean, hits int")


@query(f"WITH {ORDER_NODES_SQL} SELECT name, concat_ws('; ', CASE WHEN version = 0 THEN 'version: below 1' END, CASE WHEN confidence <= 0.5 THEN 'validator 0 failed' END) AS errors FROM nodes")
def repository_validate(spark, sf_dir):
    """Built-in checks and a validator of one's own, over rows that were not created."""
    repo = NodeRepository(_store(spark), validators=[lambda df: df["metadata.metrics.confidence"] > 0.5])
    return repo.validate(v.order_nodes(spark, sf_dir)).select("name", F.array_join("errors", "; ").alias("errors"))


_STORED = HANDOFF_SQL


@query(f"WITH {_STORED}, s AS (SELECT min(node) AS s FROM n) SELECT 'outgoing' AS direction, e.src, e.dst FROM e, s WHERE src = s UNION ALL SELECT 'incoming', e.src, e.dst FROM e, s WHERE dst = s UNION ALL SELECT 'both', e.src, e.dst FROM e, s WHERE src = s OR dst = s UNION ALL SELECT 'calls', e.src, e.dst FROM e WHERE relation_type = 'calls'")
def node_edges_direction(spark, sf_dir):
    """Edges of the least user by direction, and all of one type, from an edge repository."""
    g = v.handoff(spark, sf_dir)
    repo = _edge_repository(spark, g.edges())
    start = repo.rows.agg(F.min(F.least("from_entity", "to_entity"))).first()[0]
    parts = [(d, repo.of_node(start, d)) for d in ("outgoing", "incoming", "both")] + [("calls", repo.by_type("calls"))]
    rows = [df.select(F.lit(d).alias("direction"), F.col("from_entity").alias("src"), F.col("to_entity").alias("dst")) for d, df in parts]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query(f"WITH {PLACES_SQL}, r AS (SELECT n_regionkey, min(least('C' || c_custkey, coalesce('S' || s_suppkey, 'Z'))) AS least FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1), a AS (SELECT 'C' || c_custkey AS node, n_regionkey AS g FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'S' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'N' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT DISTINCT 'R' || n_regionkey, n_regionkey FROM nation) SELECT node, min(node) OVER (PARTITION BY g) AS component FROM a")
def repository_components(spark, sf_dir):
    return _edge_repository(spark, v.places(spark, sf_dir)[0].edges()).connected_components()


@query(f"WITH {TRADE_SQL}, t AS (SELECT min(node) AS a, max(node) AS b FROM n) SELECT 'path' AS part, a || '>' || b AS what FROM t JOIN e ON src = a AND dst = b UNION ALL SELECT 'path', a || '>' || x.dst || '>' || b FROM t JOIN e x ON x.src = a JOIN e y ON y.src = x.dst AND y.dst = b WHERE x.dst NOT IN (a, b) UNION ALL SELECT 'near', src || '>' || dst FROM e WHERE src IN (SELECT a FROM t UNION SELECT dst FROM e, t WHERE src = a) AND dst IN (SELECT a FROM t UNION SELECT dst FROM e, t WHERE src = a)")
def repository_paths(spark, sf_dir):
    """Paths of up to two edges between two nations, and the neighbourhood of one, from an edge repository."""
    g = v.trade(spark, sf_dir)
    repo = _edge_repository(spark, g.edges())
    a, b = repo.rows.agg(F.min(F.least("from_entity", "to_entity")), F.max(F.greatest("from_entity", "to_entity"))).first()
    found = repo.find_paths(a, b, max_depth=2).select(F.lit("path").alias("part"), F.array_join("nodes", ">").alias("what"))
    return found.union(repo.neighborhood(a).select(F.lit("near").alias("part"), F.concat_ws(">", "src", "dst").alias("what")))


# the graph


@query(f"WITH {HANDOFF_SQL}, kept AS (SELECT src, dst, weight FROM e WHERE relation_type <> 'calls') SELECT 'rolled back' AS stage, count(*) AS edges, sum(weight) AS weight FROM e UNION ALL SELECT 'committed', count(*), sum(weight) FROM kept")
def graph_transaction(spark, sf_dir):
    """A transaction that fails after it removed edges leaves the graph as it was; one that does not, changes it."""
    g = KGraph.from_edges(v.handoff_edges(spark, sf_dir))
    calls, rows = g.matching(F.col("relation_type") == "calls").select("src", "dst"), []
    for stage, fail in (("rolled back", True), ("committed", False)):
        try:
            with g.transaction():
                g.remove_edges(calls)
                if fail:
                    g.remove_edge("no", "edge")
        except EdgeNotFoundError:
            pass
        rows.append(g.edges().agg(F.count("*").alias("edges"), F.sum("weight").alias("weight")).select(F.lit(stage).alias("stage"), "edges", "weight"))
    return rows[0].union(rows[1])


@query(f"WITH {HANDOFF_SQL}, a AS (SELECT min(node) AS a FROM n) SELECT a AS src, dst, true AS there, 'edge' AS found FROM e, a WHERE src = a UNION ALL SELECT a, 'nobody', false, 'no node' FROM a UNION ALL SELECT a, a, EXISTS (SELECT 1 FROM e WHERE src = a AND dst = a), CASE WHEN EXISTS (SELECT 1 FROM e WHERE src = a AND dst = a) THEN 'edge' ELSE 'no edge' END FROM a WHERE NOT EXISTS (SELECT 1 FROM e WHERE src = a AND dst = a)")
def graph_lookups(spark, sf_dir):
    """has_edge and the checked lookup, for the least node and each of its neighbours, a node that is not there, and itself."""
    g = KGraph(checkpointed(v.handoff_edges(spark, sf_dir))).persist()
    start = g.nodes().agg(F.min("node")).first()[0]
    near, rows = [r["node"] for r in g.neighbors(start).collect()], []  # of one node
    for other in [*near, "nobody", *([] if start in near else [start])]:
        try:
            found = "edge" if g.edge_or_raise(start, other)["dst"] == other else "?"
        except NodeNotFoundError:
            found = "no node"
        except EdgeNotFoundError:
            found = "no edge"
        rows.append((start, other, g.has_edge(start, other), found))
    return spark.createDataFrame(rows, "src string, dst string, there boolean, found string")


@query("SELECT * FROM (VALUES ('page', 'QueryError'), ('page size', 'QueryError'), ('confidence', 'QueryError'), ('operator', 'QueryError'), ('sort', 'QueryError'), ('depth', 'QueryError'), ('strategy', 'QueryError'), ('threshold', 'QueryError'), ('window', 'QueryError'), ('fields', 'QueryError'), ('start', 'NodeNotFoundError'), ('no path', 'GraphOperationError'), ('limit', 'ValueError'), ('format', 'StorageError'), ('no node', 'NodeNotFoundError')) AS t(query, error)")
def refused_queries(spark, sf_dir):
    """What is refused, and with which error."""
    g = v.places(spark, sf_dir)[0]
    cases = {
        "page": lambda: SearchQuery(page=0).validate(), "page size": lambda: SearchQuery(page_size=0).validate(), "confidence": lambda: SearchQuery(min_confidence=2).validate(),
        "operator": lambda: SearchQuery(filters=[Filter("name", "like", "x")]).validate(), "sort": lambda: SearchQuery(sort=[Sort("name", "up")]).validate(),
        "depth": lambda: GraphQuery(max_depth=0).validate(), "strategy": lambda: GraphQuery(traversal_strategy="sideways").validate(),
        "threshold": lambda: SemanticQuery(similarity_threshold=2).validate(), "window": lambda: SemanticQuery(context_window=0).validate(), "fields": lambda: SemanticQuery(semantic_fields=[]).validate(),
        "start": lambda: paths.shortest_path(g, "nobody", "R0"), "no path": lambda: paths.shortest_path(g, "R0", "N0"), "limit": lambda: paths.all_paths(g, "N0", "R0", max_paths=0),
        "format": lambda: GraphStore(spark, "x", "csv"), "no node": lambda: NodeRepository(_store(spark)).get("nobody"),
    }
    rows = []
    for name, call in cases.items():
        try:
            call()
        except (EngineError, GraphOperationError, ValueError) as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "query string, error string")


# events


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", F.col("props").alias("data"), F.col("ts").alias("timestamp"))


def _bus(spark: SparkSession, **options) -> EventBus:
    return EventBus(spark, GraphStore(spark, _path(spark)), **options)


@query("SELECT event_type, count(*) AS events, CAST(ceil(count(*) / 100.0) AS BIGINT) AS batches, 'COMPLETED' AS status, true AS processed FROM events GROUP BY event_type")
def event_publish(spark, sf_dir):
    """All events published and delivered: what is stored, in how many batches of 100 at most, and whether each is linked to one."""
    bus = _bus(spark)
    bus.publish(_published(spark, sf_dir))
    stored = bus.events().groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("batch_id").alias("batches"), F.bool_and("processed").alias("processed"))
    books = bus.store.read("event_batches").select(F.split("id", "-")[1].alias("event_type"), "status").distinct()
    return stored.join(books, "event_type").select("event_type", "events", "batches", "status", "processed")


@query("SELECT 'first' AS handler, count(*) AS events FROM events WHERE event_type = 'click' UNION ALL SELECT 'second', count(*) FROM events WHERE event_type = 'click' UNION ALL SELECT 'other', count(*) FROM events WHERE event_type = 'view' UNION ALL SELECT 'late', count(*) FROM events WHERE event_type = 'view'")
def event_fan_out(spark, sf_dir):
    """Handlers of a type all get its events; one that subscribes late gets them by replay."""
    bus, got = _bus(spark), {}
    count = lambda name: lambda df: got.__setitem__(name, df.count())
    for kind, name in (("click", "first"), ("click", "second"), ("view", "other")):
        bus.subscribe(kind, count(name))
    bus.publish(_published(spark, sf_dir))
    bus.subscribe("view", count("late"), replay=True)
    return spark.createDataFrame(list(got.items()), "handler string, events long")


@query("SELECT 'failed' AS stage, count(*) AS dead, CAST(0 AS BIGINT) AS retries FROM events WHERE event_type = 'error' UNION ALL SELECT 'tried', count(*), count(*) FROM events WHERE event_type = 'error' UNION ALL SELECT 'delivered', 0, 0")
def event_dead_letters(spark, sf_dir):
    """A handler that fails twice: the dead letters after the delivery and each retry, and the sum of their retries."""
    bus, calls, rows = _bus(spark), [], []

    def shaky(df: DataFrame) -> None:
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("down")

    bus.subscribe("error", shaky)
    for stage, step in (("failed", lambda: bus.publish(_published(spark, sf_dir))), ("tried", bus.retry_dead_letters), ("delivered", bus.retry_dead_letters)):
        step()
        dead = bus.store.read("dead_letter_queue").agg(F.count("*"), F.coalesce(F.sum("retry_count"), F.lit(0))).first()
        rows.append((stage, dead[0], dead[1]))
    return spark.createDataFrame(rows, "stage string, dead long, retries long")


@query("""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), h AS (SELECT (count(*) + 1) // 2 AS half FROM events), w AS (SELECT event_type, n, sum(n) OVER (ORDER BY event_type) AS upto, half FROM c, h)
SELECT event_type, n AS events, CASE WHEN upto - n < half THEN 1 ELSE 2 END AS flush FROM w""")
def event_queue(spark, sf_dir):
    """Events queued type by type: they wait until half of all are there, then go out together; the rest goes out by a last flush."""
    events, got = table(spark, sf_dir, "events"), []
    bus = _bus(spark, batch_size=(events.count() + 1) // 2, batch_seconds=3600)
    kinds = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").collect()]  # five types
    for kind in kinds:
        bus.subscribe(kind, lambda df: got.append((df, flush)))
    flush = 1
    for kind in kinds:
        bus.enqueue(_published(spark, sf_dir).where(F.col("event_type") == kind))
        if got:
            flush = 2
    bus.flush()
    return reduce(DataFrame.unionByName, [df.groupBy("event_type").agg(F.count("*").alias("events")).withColumn("flush", F.lit(n)) for df, n in got])


@query("SELECT event_type, count(*) AS events, count(*) AS ids FROM events GROUP BY event_type")
def event_stream_repeated(spark, sf_dir):
    """All events written as files, published by a stream, then by one that begins anew at the same batches, as after a lost
    checkpoint: each is stored once."""
    bus, at = _bus(spark), _path(spark)
    _published(spark, sf_dir).withColumn("metadata", F.lit(None).cast("string")).write.parquet(at)
    for _ in range(2):
        bus.stream(at, f"{at}-seen", format="parquet").awaitTermination()
        remove(spark, [f"{at}-seen"])
    return bus.events().groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("id").alias("ids"))


@query("SELECT event_type, count(*) AS events FROM events GROUP BY event_type")
def event_follow(spark, sf_dir):
    """A subscription that replays what is stored, then gets what is published after: the counts of all it has seen."""
    bus, at, got = _bus(spark), _path(spark), []
    early = F.pmod(F.xxhash64("data", "timestamp"), F.lit(2)) == 0
    for part in (early, ~early):
        bus.publish(_published(spark, sf_dir).where(part), deliver=False)
        bus.follow(None, lambda df: got.append(checkpointed(df.groupBy("event_type").agg(F.count("*").alias("events")))), f"{at}-seen", once=True).awaitTermination()
    return reduce(DataFrame.unionByName, got).groupBy("event_type").agg(F.sum("events").alias("events"))


@query("SELECT n_name AS node, 'node_created' AS event_type, TIMESTAMP '2024-01-01' AS timestamp FROM nation UNION ALL SELECT n_name, 'node_deleted', TIMESTAMP '2024-01-01' FROM nation")
def event_client_helpers(spark, sf_dir):
    names = [r["n_name"] for r in table(spark, sf_dir, "nation").select("n_name").collect()]  # 25 rows
    made = []
    for what in ("created", "DELETED"):
        for n in names:
            kind, data, _, metadata = ev.entity_event("node", what, n)
            made.append((kind, data, datetime(2024, 1, 1), metadata))
    bus = _bus(spark)
    bus.publish(ev.events_frame(spark, made), deliver=False)
    return bus.get_events(start=datetime(2024, 1, 1), end=datetime(2024, 1, 1)).select(F.get_json_object("data", "$.node_id").alias("node"), "event_type", "timestamp")


@query("SELECT event_type, count(*) AS n FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 10 AND 90 GROUP BY event_type")
def event_schema_registry(spark, sf_dir):
    """A schema for each type, registered twice; invalid events are left out before the rest is published."""
    bus = _bus(spark)
    for kind in ("click", "error", "purchase", "signup", "view"):
        for low in (0, 10):
            bus.register_schema(kind, {"required": ["k"], "properties": {"k": {"type": "integer", "minimum": low, "maximum": 90}}})
    assert bus.store.read("event_schemas").count() == 5
    bus.publish(bus.checked(_published(spark, sf_dir)).where(F.size("errors") == 0).drop("errors"), deliver=False)
    return bus.events().groupBy("event_type").agg(F.count("*").alias("n"))
