import json

from compare import compare, connect
from conftest import SF
from msgsieve.llm import tool_calls as T
from msgsieve.llm.queries import ORACLE, QUERIES

KIND = "conv_id long, turn long, role string, text string, tool_calls string, tool_call_id string, id string, level int"
SCHEMAS = {
    "find": {"properties": {"q": "string", "n": "integer", "deep": "object"}, "required": ["q"], "additional": False},
    "add": {"properties": {"x": "number", "tags": "array", "on": "boolean"}, "required": ["x"]},
}


def call(i, name, arguments):
    return {"id": i, "name": name, "arguments": arguments}


def linked(spark, rows):
    rows = [(c, t, r, x, json.dumps(calls) if isinstance(calls, list) else calls, ref, "clash", 3) for c, t, r, x, calls, ref in rows]
    got = T.linked_calls(spark.createDataFrame(rows, KIND).repartition(3), SCHEMAS).collect()
    return {(r.conv_id, r.id): r for r in got}


def test_links_errors_order_and_json(spark):
    needs = lambda *ids: {"q": "x", "deep": {"of": [{"$result": i} for i in ids]}}
    rows = [
        (1, 0, "assistant", None, [call("a", "find", {"q": "é\n\"", "n": 2}), call("b", "add", '{"x": 1.50, "on": true}')], None),
        (1, 1, "tool", "result b", None, "b"),
        (1, 2, "tool", "result a", None, "a"),
        (1, 3, "tool", "again", None, "a"),
        (1, 4, "assistant", None, [call("c", "find", needs("d", "a")), call("d", "find", needs("a", "b", "d", "gone"))], None),
        (1, 5, "assistant", None, [call("x", "find", needs("y")), call("y", "find", needs("x")), call("z", "find", needs("x"))], None),
        (1, 6, "tool", "nobody asked", None, "q"),
        (2, 0, "tool", "too soon", None, "a"),
        (2, 1, "assistant", None, [call("a", "find", {"n": "2", "other": 1}), call("a", "add", {"x": 1}), call("e", "fly", {})], None),
        (2, 2, "assistant", None, [call("f", "add", "no json"), call("g", "add", [1]), call("h", "add", {"x": "1", "tags": {}, "on": None})], None),
        (2, 3, "assistant", None, [call(None, "add", {"x": 1})], None),
        (2, 4, "assistant", "", "no json", None),
        (2, 5, "assistant", "", '{"id": "o"}', None),
        (None, 0, "assistant", None, [call("a", "add", {"x": 1})], None),
    ]
    got = linked(spark, rows)
    assert {k: r.status for k, r in got.items()} == {
        (1, "a"): "linked", (1, "b"): "linked", (1, "c"): "unanswered", (1, "d"): "unanswered", (1, "q"): "orphan",
        (1, "x"): "unanswered", (1, "y"): "unanswered", (1, "z"): "unanswered", (2, "a"): "early", (2, "e"): "unanswered",
        (2, "f"): "unanswered", (2, "g"): "unanswered", (2, "h"): "unanswered",
    }
    assert {k[1]: r.level for k, r in got.items() if k[0] == 1} == {"a": 0, "b": 0, "d": 1, "c": 2, "x": None, "y": None, "z": None, "q": None}
    errors = {k: r.errors for k, r in got.items() if r.errors}
    assert errors == {
        (2, "a"): ["missing q", "n is not integer", "unexpected other"], (2, "e"): ["unknown tool"],
        (2, "f"): ["arguments are no object"], (2, "g"): ["arguments are no object"],
        (2, "h"): ["on is not boolean", "tags is not array", "x is not number"],
    }
    assert got[1, "a"].json == '{"arguments":{"n":2,"q":"é\\n\\""},"id":"a","name":"find","result":"result a"}'
    assert got[1, "b"].json == '{"arguments":{"on":true,"x":1.5},"id":"b","name":"add","result":"result b"}'
    assert (got[2, "a"].copies, got[1, "a"].result_copies) == (2, 2)


def test_empty_and_long(spark):
    assert linked(spark, []) == {}
    long = "x" * 1_000_000
    got = linked(spark, [(1, 0, "assistant", None, [call("a", "find", {"q": long})], None), (1, 1, "tool", long, None, "a")])
    assert json.loads(got[1, "a"].json) == {"arguments": {"q": long}, "id": "a", "name": "find", "result": long}


def test_query_equals_sql(spark):
    assert compare(spark, connect(SF), SF, "op4_tool_calls", QUERIES["op4_tool_calls"], ORACLE["op4_tool_calls"]) == ""


def test_query_runs_no_python(spark):
    plan = QUERIES["op4_tool_calls"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
