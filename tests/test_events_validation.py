import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftgraph import errors
from weftgraph.errors import ValidationError
from weftgraph.schema import with_edge_defaults, with_node_defaults
from weftgraph.sources.store import GraphStore
from weftgraph.streaming import events as ev
from weftgraph.streaming.bus import EventBus, require_type, windowed_counts
from weftgraph.validation import Custom, InRange, JsonSchemas, Matches, OfType, Required, Rule, RuleSet, report_json, report_text, validate_edges, validate_nodes


def at(s):
    return datetime(2024, 1, 1, 0, 0, s)


def test_rules(spark):
    df = spark.createDataFrame([("a", 5, "x1"), (" ", 50, None), (None, None, "None")], "name string, n int, code string")
    rules = RuleSet().add("name", Required("needed")).add("n", InRange("range", 1, 10)).add("code", Matches("form", "x|None")).add("n", OfType("kind", ("int", "float"))).add("no", Required("there")).add("name", Custom("own", lambda c: c == "a"))
    out = [r["validation"] for r in rules.validate(df).collect()]
    assert [v["errors"] for v in out] == [["no: there"], ["name: needed", "n: range", "no: there", "name: own"], ["name: needed", "n: range", "n: kind", "no: there", "name: own"]]
    text = rules.validate(df).select(report_text(), report_json()).first()
    assert text[0] == "Error: no: there" and json.loads(text[1])["is_valid"] is False
    assert RuleSet().validate(df).select(report_text()).first()[0] == "Validation passed successfully"
    with pytest.raises(NotImplementedError):
        Rule("m").passes(df, "name")


def test_node_and_edge_invariants(spark):
    nodes = with_node_defaults(spark.createDataFrame([("a", "dataset"), (" ", "x")], "name string, entity_type string"))
    assert [r["validation"]["errors"] for r in validate_nodes(nodes).collect()] == [[], ["name: blank", "entity_type: unknown"]]
    m = F.col("metadata")
    bad = nodes.limit(1).withColumns({"metadata": m.withField("version", F.lit(0)).withField("author", F.lit("")).withField("last_modified", F.lit(datetime(1999, 1, 1))).withField("metrics.impact", F.lit(1.5)), "metrics": F.create_map(F.lit("x"), F.lit(float("nan"))), "attributes": F.lit('{"k": null}')})
    assert validate_nodes(bad).first()["validation"]["errors"] == ["metrics: holds a value that is no finite number", "last_modified: earlier than created_at", "version: below 1", "author: blank", "impact: outside 0 to 1", "attributes: a blank key or a null value"]
    edges = with_edge_defaults(spark.createDataFrame([("a", "b", "calls")], "from_entity string, to_entity string, relation_type string"))
    assert validate_edges(edges).first()["validation"]["is_valid"]
    bad = edges.withColumns({"metadata": m.withField("weight", F.lit(-1.0)).withField("confidence", F.lit(2.0)), "impact_score": F.lit(-0.1), "validation_status": F.lit("?"), "custom_metrics": F.expr("map('m', named_struct('value', 2D, 'min', 0D, 'max', 1D))")})
    assert validate_edges(bad).first()["validation"]["errors"] == ["confidence: outside 0 to 1", "weight: missing or below 0", "impact_score: outside 0 to 1", "validation_status: none of unverified, verified, invalid", "custom_metrics: outside their own bounds"]


def test_json_schemas(spark):
    s = JsonSchemas()
    s.register("t", json.dumps({"required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1, "maximum": 9}, "b": {"type": "string", "enum": ["x", "y"], "pattern": "^x", "minLength": 1, "maxLength": 3}, "c": {"type": ["array", "null"]}}}))
    rows = [("t", '{"a": 5, "b": "x", "c": [1]}'), ("t", '{"a": 0, "b": "y"}'), ("t", '{"a": "5", "c": {}}'), ("t", "{"), ("t", "{}"), ("other", "{}"), (None, None)]
    out = [r["validation"] for r in s.validate(spark.createDataFrame(rows, "k string, d string"), "k", "d").collect()]
    assert [v["errors"] for v in out] == [[], ["'a' is less than the minimum of 1", "'b' does not match '^x'"], ["'a' is not of type integer", "'c' is not of type array, null"], ["not a JSON document", "'a' is a required property"], ["'a' is a required property"], [], []]
    assert [v["warnings"] for v in out][-2:] == [["No schema registered for other"], ["No schema registered for null"]]


def test_event_constructors():
    assert json.loads(ev.entity_event("node", "CREATED", "n1", {"x": 1})[1]) == {"node_id": "n1", "x": 1} and ev.entity_event("edge", "deleted", "e")[0] == "edge_deleted"
    assert ev.error_event("oops", {"d": 1})[0] == "schema_updated"
    for bad in (lambda: ev.entity_event("node", "moved", "n"), lambda: ev.event("nothing", {})):
        with pytest.raises(ValueError):
            bad()
    assert require_type("node_created") == "node_created"
    with pytest.raises(errors.EventError):
        require_type("x")


@pytest.fixture
def bus(spark, tmp_path):
    return EventBus(spark, GraphStore(spark, str(tmp_path / "events")), max_retries=2)


def some(spark, *rows):
    return ev.events_frame(spark, [(k, json.dumps(d), at(s), None) for k, d, s in rows])


def test_publish_deliver_replay(spark, bus):
    got = []
    handler = lambda df: got.append(sorted(json.loads(r["data"])["v"] for r in df.collect()))
    bus.subscribe("node_created", handler)
    bus.publish(some(spark, ("node_created", {"v": 1}, 1), ("node_created", {"v": 2}, 2), ("edge_created", {"v": 3}, 3)))
    assert got == [[1, 2]]
    events = bus.events()
    assert events.where("processed and batch_id is not null").count() == 3 and events.select("id").distinct().count() == 3
    assert sorted((r["status"], r["event_count"]) for r in bus.store.read("event_batches").collect()) == [("COMPLETED", 1), ("COMPLETED", 2)]
    bus.publish(some(spark, ("node_created", {"v": 9}, 9)))
    assert bus.store.read("events").select("id").distinct().count() == 4
    late = []
    bus.subscribe("node_created", lambda df: late.append([json.loads(r["data"])["v"] for r in df.collect()]), replay=True)
    assert late == [[9, 2, 1]] and bus.subscriber_count("node_created") == 2 == bus.subscriber_count()
    assert bus.unsubscribe("node_created", handler) and not bus.unsubscribe("node_created", handler)
    bus.clear_subscribers("node_created")
    bus.clear_subscribers()
    assert bus.subscriber_count() == 0
    q = ev.query_events(bus.store.read("events"), "node_created", at(1), at(2), limit=1).collect()
    assert [json.loads(r["data"])["v"] for r in q] == [2]


def test_batches_wait_for_count_or_time(spark, tmp_path):
    import time

    bus = EventBus(spark, GraphStore(spark, str(tmp_path / "events")), batch_size=3, batch_seconds=0.5)
    got = []
    bus.subscribe("node_created", lambda df: got.append(sorted((json.loads(r["data"])["v"], r["batch_no"]) for r in df.collect())))
    bus.enqueue(some(spark, ("node_created", {"v": 1}, 1)))
    assert bus.events().where("processed").count() == 0 and bus.store.read("events").count() == 1
    for _ in range(100):
        if got:
            break
        time.sleep(0.1)
    assert got == [[(1, 0)]]
    bus.batch_seconds = 3600
    bus.enqueue(some(spark, ("node_created", {"v": 2}, 2), ("node_created", {"v": 3}, 3)))
    assert len(got) == 1
    bus.enqueue(some(spark, *[("node_created", {"v": v}, v) for v in (4, 5, 6)]))
    assert got[1] == [(2, 0), (3, 0), (4, 0), (5, 1), (6, 1)] and bus.flush() == 0
    books = {r["id"]: r["event_count"] for r in bus.store.read("event_batches").collect()}
    assert sorted(books.values()) == [1, 2, 3]
    [pair] = [b for b, n in books.items() if n == 2]
    assert sorted(json.loads(r["data"])["v"] for r in bus.get_events(batch_id=pair).collect()) == [5, 6]


def test_numbers_of_a_group_over_several_ranges(spark):
    e = spark.range(500).select((F.col("id") * 37 % 500).alias("id"), F.when(F.col("id") < 450, "click").alias("event_type"), F.lit(datetime(2024, 1, 1)).alias("timestamp"))
    got = {(r["event_type"], r["id"]): r["n"] for r in ev.numbered(e, ["event_type"], ["timestamp", "id"]).collect()}
    for kind in ("click", None):
        ids = sorted(i for k, i in got if k == kind)
        assert [got[kind, i] for i in ids] == list(range(len(ids)))


def test_schema_dead_letters_and_retry(spark, bus):
    bus.register_schema("node_created", {"required": ["v"]})
    bus.register_schema("node_created", {"required": ["v"], "properties": {"v": {"minimum": 0}}})
    assert bus.store.read("event_schemas").count() == 1
    with pytest.raises(ValidationError, match="Event schema validation failed: 'v' is a required property"):
        bus.publish(some(spark, ("node_created", {}, 1)))
    assert bus.store.read("events").count() == 0
    calls = []

    def shaky(df):
        calls.append(df.count())
        if len(calls) < 3:
            raise RuntimeError("down")

    bus.subscribe("node_created", shaky)
    bus.publish(some(spark, ("node_created", {"v": 1}, 1)))
    dead = bus.store.read("dead_letter_queue").first()
    assert (dead["retry_count"], dead["error_message"]) == (0, "RuntimeError: down")
    assert bus.retry_dead_letters() == 0 and bus.store.read("dead_letter_queue").first()["retry_count"] == 1
    assert bus.retry_dead_letters() == 1 and bus.store.read("dead_letter_queue").count() == 0 and len(calls) == 3


def test_stream(spark, bus, tmp_path):
    bus.register_schema("node_created", {"required": ["v"]})
    got = []
    bus.subscribe("node_created", lambda df: got.append(df.count()))
    (tmp_path / "in").mkdir()
    for i in range(3):
        lines = [{"event_type": "node_created", "data": json.dumps({"v": i} if k else {}), "timestamp": "2024-01-01T00:00:00"} for k in range(3)]
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, lines)))
    bus.stream(str(tmp_path / "in"), str(tmp_path / "cp"), files_per_batch=2).awaitTermination()
    assert sum(got) == 6 and bus.store.read("events").count() == 6 and bus.store.read("dead_letter_queue").count() == 3
    bus.stream(str(tmp_path / "in"), str(tmp_path / "cp")).awaitTermination()  # nothing is delivered twice
    assert bus.store.read("events").count() == 6


def test_a_repeated_stream_batch_is_stored_and_handed_out_once(spark, bus, tmp_path):
    """As after a crash between a batch's work and its mark in the checkpoint."""
    got = []
    bus.subscribe("node_created", lambda df: got.append(sorted(json.loads(r["data"])["v"] for r in df.collect())))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"event_type": "node_created", "data": json.dumps({"v": i}), "timestamp": "2024-01-01T00:00:00"}) for i in range(5)))
    run = lambda: bus.stream(str(tmp_path / "in"), str(tmp_path / "cp")).awaitTermination()
    run()
    for f in (tmp_path / "cp" / "commits").glob("*0*"):
        f.unlink()
    run()
    assert bus.store.read("events").count() == 5 and got == [list(range(5))]
    books = bus.store.read("event_batches").collect()
    assert [b["event_count"] for b in books] == [5] and bus.store.read("event_links").count() == 5
    # died after the commit, before the delivery: the handlers get it
    for f in (tmp_path / "cp" / "commits").glob("*0*"):
        f.unlink()
    committed = bus.store.committed
    bus.store.committed = lambda name, n: committed(name, n) and not name.endswith("/delivered")
    run()
    assert bus.store.read("events").count() == 5 and got == [list(range(5))] * 2


def test_ids_of_two_publishers(spark, bus):
    other = EventBus(spark, GraphStore(spark, bus.store.path))
    for k in range(3):
        bus.publish(some(spark, *[("node_created", {"v": v}, v) for v in range(4)]), deliver=False)
        other.publish(some(spark, *[("node_created", {"v": v}, v) for v in range(4)]), deliver=False)
    assert bus.events().count() == bus.events().select("id").distinct().count() == 24


def test_count_or_timeout_batches_of_a_stream(spark, tmp_path):
    """250 events go out as 100 and 100, then 50 when their time is over, in state that a restart finds again."""
    import time

    got = []
    (tmp_path / "in").mkdir()

    def put(name, kinds):
        rows = [{"event_type": k, "data": json.dumps({"v": i}), "timestamp": "2024-01-01T00:00:00"} for i, k in enumerate(kinds)]
        (tmp_path / f".{name}").write_text("\n".join(map(json.dumps, rows)))
        (tmp_path / f".{name}").rename(tmp_path / "in" / f"{name}.json")

    def start(seconds):
        bus = EventBus(spark, GraphStore(spark, str(tmp_path / "events")), batch_seconds=seconds)
        bus.handlers.clear()
        bus.subscribe("node_created", lambda df: got.extend(sorted((r["batch_no"], r["count"]) for r in df.groupBy("batch_no").count().collect())))
        return bus, bus.batch_stream(str(tmp_path / "in"), str(tmp_path / "cp"), seconds=0.2)

    def wait(query, n):  # for the books, which are the end of a delivery
        end = time.time() + 150
        while bus.store.read("event_batches").count() < n and time.time() < end and query.isActive:
            time.sleep(0.3)
        assert query.exception() is None

    put("a", ["node_created"] * 250)
    bus, query = start(20)
    wait(query, 2)
    assert got == [("0.0", 100), ("0.1", 100)] and bus.store.read("events").count() == 200
    query.stop()
    bus, query = start(20)  # the 50 wait on
    wait(query, 3)
    assert got[2:] == [("0.2", 50)]
    put("b", ["node_created"] * 30 + ["edge_created"])
    wait(query, 5)
    query.stop()
    assert got[3:] == [("0.3", 30)] and bus.events().where("processed").count() == 281
    assert sorted(b["event_count"] for b in bus.store.read("event_batches").collect()) == [1, 30, 50, 100, 100]


def test_follow_replays_and_goes_on(spark, bus, tmp_path):
    """Events published during the replay reach the handler once; so does what comes after a restart."""
    got = []
    values = lambda df: sorted(json.loads(r["data"])["v"] for r in df.collect())

    def handler(df):
        if not got:
            bus.publish(some(spark, ("node_created", {"v": 3}, 3)), deliver=False)
        got.append(values(df))

    bus.publish(some(spark, ("node_created", {"v": 1}, 1), ("edge_created", {"v": 9}, 1)), deliver=False)
    bus.publish(some(spark, ("node_created", {"v": 2}, 2)), deliver=False)
    run = lambda: bus.follow("node_created", handler, str(tmp_path / "cp"), once=True).awaitTermination()
    run()
    run()
    assert sum(got, []) == [1, 2, 3]
    bus.publish(some(spark, ("node_created", {"v": 4}, 4)), deliver=False)
    run()
    assert sum(got, []) == [1, 2, 3, 4]
    new = []
    follow = lambda: bus.follow(None, lambda df: new.append(values(df)), str(tmp_path / "new"), replay=False, once=True).awaitTermination()
    follow()
    assert new == []
    bus.publish(some(spark, ("node_created", {"v": 5}, 5), ("edge_created", {"v": 6}, 5)), deliver=False)
    follow()
    assert new == [[5, 6]]


def test_batches_and_windows(spark):
    e = spark.createDataFrame([(i, "click" if i % 3 else "view", datetime(2024, 1, 1, 0, 0, i)) for i in range(30)], "id long, event_type string, timestamp timestamp_ntz")
    sizes = {(r["event_type"], r["batch_no"]): r["count"] for r in ev.batched(e, 8).groupBy("event_type", "batch_no").count().collect()}
    assert sizes == {("click", 0): 8, ("click", 1): 8, ("click", 2): 4, ("view", 0): 8, ("view", 1): 2}
    timed = {(r["event_type"], r["batch_no"]): r["count"] for r in ev.batched(e, 8, gap=15).groupBy("event_type", "batch_no").count().collect()}
    assert timed == {("click", 0): 8, ("click", 1): 2, ("click", 2): 8, ("click", 3): 2, ("view", 0): 5, ("view", 1): 5}
    assert {(r["event_type"], r["n"]) for r in windowed_counts(e, width="1 minute").collect()} == {("click", 20), ("view", 10)}


def test_error_texts():
    assert str(errors.ValidationError("x")) == "Validation Error: x" and str(errors.GraphOperationError("x")) == "Graph Operation Error: x"
    assert issubclass(errors.NodeNotFoundError, errors.ResourceNotFoundError) and str(errors.EdgeNotFoundError("x")) == "x"


def test_nested_schemas_and_unknown_keywords(spark):
    schemas = JsonSchemas()
    schemas.register("t", {"title": "x", "required": ["a"], "properties": {"a": {"type": "object", "required": ["b"], "properties": {"b": {"type": "integer", "minimum": 2}, "c": {"properties": {"d": {"maxLength": 2}}}}}}})
    rows = ['{"a": {"b": 2, "c": {"d": "xy"}}}', '{"a": {"b": 1, "c": {"d": "xyz"}}}', '{"a": {}}', '{"a": 5}', "{}", "[]"]
    df = spark.createDataFrame([("t", r) for r in rows], "kind string, data string")
    got = [r["e"] for r in df.select(schemas.errors(F.col("kind"), F.col("data")).alias("e")).collect()]
    assert got == [[], ["'a.b' is less than the minimum of 2", "'a.c.d' is too long"], ["'a.b' is a required property"], ["'a' is not of type object"], ["'a' is a required property"], ["'a' is a required property"]]
    for bad in ({"items": {}}, {"properties": {"a": {"properties": {"b": {"anyOf": []}}}}}):
        with pytest.raises(ValidationError, match="without a test"):
            schemas.register("u", bad)
