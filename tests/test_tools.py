import json

import pytest

from weftgraph.errors import QueryError
from weftgraph.sources.store import GraphStore
from weftgraph.tools import Tools


def test_tools(spark, tmp_path):
    t = Tools(GraphStore(spark, str(tmp_path / "s")))
    assert list(t.call("create_nodes", {"nodes": [{"name": "a", "entity_type": "dataset"}, {"name": "b", "entity_type": "metric"}]})) == ['{"changed": 2}']
    list(t.call("create_edges", {"edges": [{"from_entity": "a", "relation_type": "calls", "to_entity": "b"}]}))
    assert [json.loads(x)["name"] for x in t.call("get_nodes", {"filters": {"entity_type": "metric"}})] == ["b"]
    assert len(list(t.read("kg://edges"))) == 1 == len(list(t.call("get_edges")))
    list(t.call("update_nodes", {"nodes": [{"name": "b", "entity_type": "library"}]}))
    list(t.call("delete_nodes", {"nodes": [{"name": "a"}]}))
    assert [json.loads(x)["entity_type"] for x in t.read("kg://nodes")] == ["library"] and list(t.read("kg://edges")) == []
    for bad in (lambda: list(t.call("nothing")), lambda: list(t.read("kg://x"))):
        with pytest.raises(QueryError):
            bad()
