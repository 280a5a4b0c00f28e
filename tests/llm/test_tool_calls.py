import json

import duckdb

from lifelog.llm import tool_calls

CALLS = "conv_id long, call_id string, parent_id string, turn long, name string, arguments string"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = {"add": (("a", "integer", True), ("b", "integer", True), ("note", "string", False)), "log": (("text", "string", True),)}


def link(spark, calls, results):
    rows = tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS, ("log",)).collect()
    return {(r.conv_id, r.call_id): r for r in rows}


def test_query_against_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = sorted(db.execute(tool_calls.ORACLE["op10_tool_calls"]).fetchall())
    got = sorted(map(tuple, tool_calls.op10_tool_calls(spark, sf).collect()))
    assert got == want
    for r in got:
        line = json.loads(r[-1])
        assert r[-1] == json.dumps(line, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_status_order_and_problems(spark):
    good = '{"b": 2, "a": 1}'
    out = link(spark, [
        (1, "x", None, 0, "add", good), (1, "y", "x", 1, "add", '{"a": "1", "c": 0}'), (1, "z", "y", 2, "log", '{"text": "t"}'),
        (1, "p", "gone", 3, "add", good), (1, "q", None, 4, "nope", "{}"), (1, "r", None, 5, "add", "[1"), (1, "s", None, 6, "add", None),
        (2, "x", "y", 0, "add", good), (2, "y", "x", 1, "add", good), (2, "w", "x", 2, "add", good), (3, "m", "m", 0, "add", good),
        (4, "d", None, 1, "add", good), (4, "d", None, 0, "add", '{"a": 3, "b": 4}'), (None, "x", None, 0, "add", good), (4, None, None, 0, "add", good),
    ], [(1, "x", 1, "3"), (1, "lost", 9, "?"), (2, "x", 1, "3"), (4, "d", 2, "b"), (4, "d", 1, "a"), (None, None, 0, "r")])
    assert [out[1, c].status for c in "xyzpq"] == ["linked", "pending", "done", "pending", "pending"]
    assert [out[1, c].depth for c in "xyzpq"] == [0, 1, 2, 0, 0]
    assert [out[1, c].problems for c in "xyzpqrs"] == [
        "", "type:a,missing:b,unknown:c", "", "parent", "tool", "arguments", "arguments"]
    assert out[1, "lost"].status == "orphan" and out[1, "lost"].depth is None
    assert {out[2, c].status for c in "xyw"} | {out[3, "m"].status} == {"cyclic"} and out[2, "w"].depth == -1
    d = out[4, "d"]
    assert (d.n_calls, d.n_results, d.turn) == (2, 2, 0) and json.loads(d.line)["result"] == "a"
    assert out[None, "x"].status == out[4, None].status == out[None, None].status == "unidentified"
    assert json.loads(out[1, "x"].line)["arguments"] == {"a": 1, "b": 2}
    assert out[1, "x"].line == ('{"arguments":{"a":1,"b":2},"id":"x","name":"add","parent":null,"problems":[],"result":"3","status":"linked"}')


def test_long_chain_in_one_conversation(spark):
    calls = [(1, f"c{i}", f"c{i - 1}" if i else None, 500 - i, "add", '{"a":1,"b":2}') for i in range(300)]
    out = link(spark, calls, [(1, "c299", 9, "r")])
    assert all(out[1, f"c{i}"].depth == i for i in range(300))


def test_conversations_with_odd_rows(spark):
    turns = spark.createDataFrame([
        (1, 0, "system", "be kind", 1), (1, 1, "user", "hi", 1), (1, 2, "assistant", "hello", 1), (1, 3, "user", None, 1), (1, 3, "user", None, 1),
        (1, 9, "assistant", "late", 1), (None, 0, "user", "x", 1), (2, None, "assistant", "y", 1), (3, 0, None, "", 1),
        (4, 0, "user", "w " * 50_000, 1)], "conv_id long, turn long, role string, text string, call_id int")
    out = {(r.conv_id, r.turn, r.call_id): r for r in tool_calls.link(*tool_calls.conversation_calls(turns)).collect()}
    assert out[1, 0, "1:0"].status == "done" and out[1, 1, "1:1"].status == "linked" and out[1, 1, "1:1"].depth == 1
    assert out[1, 3, "1:3"].problems == "type:prompt" and out[1, 3, "1:3"].n_calls == 2 and out[1, 3, "1:3"].depth == 2
    assert out[1, 9, "1:8"].status == "orphan" and out[None, 0, None].status == out[2, None, None].status == "unidentified"
    assert json.loads(out[4, 0, "4:0"].line)["arguments"]["words"] == 50_000
    assert tool_calls.link(*tool_calls.conversation_calls(turns.limit(0))).count() == 0
