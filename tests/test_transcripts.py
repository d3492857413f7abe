import json

import pytest
import zstandard
from pyspark.sql import functions as F

from lorekeep.operators import turns as T
from lorekeep.sources import transcripts as X

PARTS = [{"type": "text", "text": "one"}, {"type": "text", "text": "hidden", "thought": True}, {"type": "image", "url": "x"}, {"type": "text", "text": "two"}]
EVENTS = {
    "antigravity": ({"type": "USER_INPUT", "content": "<USER_REQUEST>\nask\n</USER_REQUEST> more"}, "user", "ask"),
    "claude": ({"type": "x", "message": {"role": "assistant", "content": PARTS}}, "assistant", "one\ntwo"),
    "codex": ({"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "hi"}]}}, "user", "hi"),
    "copilot": ({"type": "assistant.message", "data": {"content": "done"}}, "assistant", "done"),
    "cursor": ({"role": "user", "message": {"content": "[not a list"}}, "user", "[not a list"),
    "freebuff": ({"variant": "ai", "blocks": [{"type": "text", "text": "b"}]}, "assistant", "b"),
    "gemini": ({"type": "gemini", "content": "g"}, "assistant", "g"),
    "grok": ({"type": "user", "content": "q"}, "user", "q"),
    "kilo": ({"message": {"role": "user"}, "parts": PARTS}, "user", "one\ntwo"),
    "kiro": ({"payload": {"type": "assistant", "content": "k"}}, "assistant", "k"),
    "mcode": ({"type": "user", "message": {"content": "m"}}, "user", "m"),
    "opencode": ({"message": {"role": "assistant"}, "parts": [{"text": "o"}]}, "assistant", "o"),
    "qwen": ({"type": "assistant", "message": {"parts": [{"text": "w"}, {"text": "t", "thought": True}]}}, "assistant", "w"),
}


def frame(spark, rows):
    return spark.createDataFrame([("s", src, n, json.dumps(e)) for n, (src, e) in enumerate(rows)], "session string, source string, line long, event string")


def test_every_dialect(spark):
    rows = X.dialogue(frame(spark, [(s, e) for s, (e, _, _) in EVENTS.items()])).collect()
    assert {r["source"]: (r["role"], r["content"]) for r in rows} == {s: (role, text) for s, (_, role, text) in EVENTS.items()}
    assert set(EVENTS) | {"vscode"} == set(X.SOURCES)


def test_vscode_requests_are_two_turns(spark):
    event = {"message": {"text": "ask"}, "response": [{"content": {"value": "a"}}, {"kind": "x"}, {"value": "b"}]}
    rows = X.dialogue(frame(spark, [("vscode", event)])).orderBy("part").collect()
    assert [(r["role"], r["content"]) for r in rows] == [("user", "ask"), ("assistant", "a\nb")]


def test_other_events_say_nothing(spark):
    rows = [("codex", {"type": "event_msg"}), ("claude", {"type": "summary"}), ("gemini", {"type": "user", "content": "  "}), ("nobody", {"role": "user", "content": "x"})]
    assert X.dialogue(frame(spark, rows)).count() == 0


def test_command_output_is_a_tool(spark):
    rows = X.dialogue(frame(spark, [("codex", {"type": "item_completed", "item": {"type": "command_execution", "stdout": "ok"}})])).collect()
    assert [(r["role"], r["content"]) for r in rows] == [("tool", "ok")]


def test_tool_calls(spark):
    call = lambda name, **args: {"type": "response_item", "payload": {"type": "function_call", "call_id": name, "name": name, "arguments": json.dumps(args)}}
    rows = [("codex", call("Read", file_path="./a.py")), ("codex", call("grep", pattern="x")), ("codex", call("bash", command="cat b.py")), ("codex", call("sh", command="make")), ("codex", call("write", path="'c'")), ("codex", call("think", x="y"))]
    got = {r["call_id"]: (r["action"], r["target"]) for r in X.tool_calls(frame(spark, rows)).collect()}
    assert got == {"Read": ("read", "a.py"), "grep": ("search", "x"), "bash": ("read", "b.py"), "sh": ("status", "make"), "write": ("write", "c")}


def test_files_are_read_plain_and_packed(spark, tmp_path):
    lines = "\n".join([json.dumps({"type": "user", "content": "a"}), "broken{", json.dumps({"type": "user", "content": "b"})])
    (tmp_path / "s1.jsonl").write_text(lines)
    (tmp_path / "s2.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress(lines.encode()))
    rows = X.dialogue(X.read_events(spark, str(tmp_path), "grok")).collect()
    assert {(r["session"], r["line"], r["content"]) for r in rows} == {(s, n, c) for s in ("s1", "s2") for n, c in ((1, "a"), (3, "b"))}


def test_documents_are_read(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"messages": [{"type": "user", "content": "a"}, {"type": "gemini", "content": "b"}]}))
    rows = X.dialogue(X.read_documents(spark, str(tmp_path), "gemini")).orderBy("line").collect()
    assert [(r["session"], r["line"], r["role"]) for r in rows] == [("g", 1, "user"), ("g", 2, "assistant")]


@pytest.mark.parametrize("name,fine", [("123e4567-e89b-12d3-a456-426614174000", True), ("ses_abc", True), ("mvs_1", True), ("2026-01-01T10:00:00.000Z", True), ("../x", False), ("", False)])
def test_session_ids(spark, name, fine):
    assert spark.createDataFrame([(name,)], "s string").select(X.is_session_id(F.col("s"))).first()[0] == fine


def test_pruning_rules(spark):
    tools = spark.createDataFrame([
        ("s", "read", "a", 1, 2, "x", False), ("s", "read", "b", 3, 4, "x", False), ("s", "read", "b", 5, 6, "x", False), ("s", "search", "q", 7, 8, "No matches found", False),
        ("s", "read", "c", 9, 10, "x", True), ("s", "read", "a", 18, 19, "x", False),
    ], "session string, action string, target string, call_line long, line long, content string, is_error boolean")
    writes = spark.createDataFrame([("s", "a", 11), ("s", "c", 12)], "session string, target string, line long")
    newest = spark.createDataFrame([("s", 20)], "session string, last long")
    got = {(r["line"], r["rule"], r["by_line"]) for r in T.prune_decisions(tools, writes, newest).collect()}
    assert got == {(2, "superseded_read", 11), (4, "duplicate_read", 6), (8, "empty_search", None)}


def test_calls_pair_with_outputs_once(spark):
    calls = spark.createDataFrame([("s", 1, "c", "read", "a"), ("s", 5, "c", "read", "z"), ("s", 2, None, "read", "b")], "session string, line long, call_id string, action string, target string")
    outputs = spark.createDataFrame([("s", 3, "c", "one", False), ("s", 4, "c", "two", False)], "session string, line long, call_id string, content string, is_error boolean")
    assert [(r["target"], r["call_line"], r["line"], r["content"]) for r in T.paired(calls, outputs).collect()] == [("a", 1, 3, "one")]


def test_confirmed_plans_beat_newer_ones(spark):
    rows = spark.createDataFrame([("s", 1, ["a"], True), ("s", 9, ["b"], False), ("t", 2, ["c"], False)], "session string, line long, items array<string>, confirmed boolean")
    assert {(r["session"], r["line"]) for r in T.task_state(rows).collect()} == {("s", 1), ("t", 2)}


def test_outputs_are_claimed_by_id_then_line_then_nearness(spark):
    calls = spark.createDataFrame([("s", 1, "a"), ("s", 3, None), ("s", 6, None), ("s", 9, "z")], "session string, line long, call_id string")
    outputs = spark.createDataFrame([("s", 2, None, None), ("s", 4, None, 6), ("s", 5, "a", None), ("t", 1, None, None)], "session string, line long, call_id string, call_line long")
    got = {(r["call_line"], r["line"], r["way"]) for r in T.paired_in_order(calls, outputs).collect()}
    assert got == {(1, 5, "id"), (6, 4, "line")}
    more = outputs.union(spark.createDataFrame([("s", 10, None, None)], outputs.schema))
    assert (9, 10, "near") in {(r["call_line"], r["line"], r["way"]) for r in T.paired_in_order(calls, more).collect()}


def test_plans(spark):
    calls = spark.createDataFrame([
        ("s", 1, "c1", "update_plan", json.dumps({"plan": [{"step": "a", "status": "completed"}, {"step": "b", "status": "in_progress"}, {"step": "c", "status": "pending"}]})),
        ("s", 5, "c2", "TodoWrite", json.dumps({"todos": [{"content": "x", "status": "odd"}, {"content": " "}]})), ("s", 6, "c3", "bash", "{}"), ("s", 7, "c4", "update_plan", "nonsense"),
    ], "session string, line long, call_id string, name string, arguments string")
    rows = {r["line"]: r for r in T.plan_writes(calls).withColumn("o", T.outstanding(F.col("items"))).collect()}
    assert set(rows) == {1, 5} and tuple(rows[1]["o"]) == ("b", "c", 2)
    assert [(i["content"], i["status"]) for i in rows[5]["items"]] == [("x", "unknown")]
