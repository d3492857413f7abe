import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F
from test_graph import AT, journal, link, node

from lorekeep.functions import cues
from lorekeep.operators import context as C
from lorekeep.operators import graph as G
from lorekeep.operators import sessions as U
from lorekeep.operators import trace as T
from lorekeep.sources import sessions as S


def test_request_terms():
    assert cues.request_terms("The red-lamp plan, of Weemed!") == ["red", "lamp", "plan", "weemed", "red-lamp"]
    assert cues.request_terms("部署授權 x") == ["部署授權", "部署", "署授", "授權"]
    assert cues.identity_terms(["ab", "abc", "部署", "a-b"]) == ["abc", "部署", "a-b"]
    assert cues.sanitized('a:b "c"').split() == ["a", "b", "c"]
    assert cues.operation("please MODIFY it") == "modify_asset" and cues.edits_asset("new Logo") and cues.constraint_cues("粗細一致") == ["粗細要一致"]


def test_since():
    now = datetime(2026, 3, 2, 10, tzinfo=UTC)
    at = lambda t: cues.since(t, now).isoformat()
    assert [at(t) for t in (None, "today", "2d", "48H", "2026-01-05", "2026-01-05T01:02:03Z")] == [
        "2026-03-01T00:00:00+00:00", "2026-03-02T00:00:00+00:00", "2026-02-28T10:00:00+00:00", "2026-02-28T10:00:00+00:00", "2026-01-05T00:00:00+00:00", "2026-01-05T01:02:03+00:00",
    ]
    with pytest.raises(ValueError):
        cues.since("soon", now)


def test_cues_in_columns(spark):
    one = lambda text, f: spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]
    assert one(" <user_information>\nx</user_information> ", cues.is_injected) and not one("<user_information></user_information>", cues.is_injected)
    assert one("see [x](file:///out/a%20b.pdf), /tmp/y.PNG. and z.md", cues.delivered_paths) == ["/out/a b.pdf", "/tmp/y.PNG"]
    assert one("It was approved by them", cues.approval_claim) and one("審查已通過", cues.approval_claim) and not one("審查通過", cues.approval_claim)
    assert one("data:image/png;base64,AA", cues.image_uri) and one("2026-01-01T00:00:00.5+08:00", cues.epoch_seconds) == 1767225600
    assert json.loads(spark.createDataFrame([("x" * 20_000,)], "x string").select(cues.bounded(F.col("x"), F.lit(7)).alias("y")).first()["y"]) == {"type": "oversized", "line": 7, "bytes": 20_000}
    assert one("the Report 部署", cues.file_terms) == ["report", "部署"]


BASE = [
    node("project:lamp", type="project", label="Lamp"), node("project:desk", type="project", label="Desk"), node("task:1", type="task", label="Lamp wiring", status="open"),
    node("task:2", type="task", label="Desk wiring"), node("task:3", type="task", label="Lamp shade"), node("decision:1", type="Decision", label="Use copper", status="accepted"),
    link("task:1", "project:lamp", "BELONGS_TO"), link("task:2", "project:desk", "BELONGS_TO"), link("task:3", "project:lamp", "BELONGS_TO"), link("decision:1", "task:1", "SUPPORTS"),
]


def test_a_named_task_brings_its_project_and_decisions(spark):
    c = C.context(journal(spark, *BASE), "Lamp wiring", AT)
    assert c.resolution == "retrieved" and c.projects == ["project:lamp"] and c.total == 1 and c.next_offset is None
    assert [(r["id"], r["score"], r["why"]) for r in c.candidates.collect()] == [("task:1", 1.0, "literal_match")]
    assert [r["id"] for r in c.decisions.collect()] == ["decision:1"]
    assert [(r["id"], r["total"]) for r in c.neighbours.collect()] == [("task:3", 1)]


def test_two_projects_are_ambiguous(spark):
    c = C.context(journal(spark, *BASE), "wiring", AT)
    assert c.resolution == "ambiguous" and c.projects == ["project:desk", "project:lamp"] and c.total == 2


def test_single_terms_are_partial_and_nothing_is_missing(spark):
    c = C.context(journal(spark, *BASE), "copper umbrella", AT)
    assert c.resolution == "partial" and [r["id"] for r in c.candidates.collect()] == ["decision:1"] and "umbrella" in c.missing[0]
    assert C.context(journal(spark, *BASE), "zeppelin", AT).resolution == "missing"
    assert C.context(journal(spark, *BASE), " ", AT).total == 0


def test_asset_edits_need_an_approved_baseline(spark):
    asset = node("artifact:logo", type="Artifact", label="Lamp logo.svg", status="Approved", location_verified="verified")
    assert C.context(journal(spark, *BASE, asset), "redraw lamp logo", AT).resolution == "ready"
    assert C.context(journal(spark, *BASE), "redraw lamp logo", AT).resolution == "missing"


def test_pages_of_candidates(spark):
    many = [node(f"t:{k:02}", type="task", label=f"gear {k:02}") for k in range(15)]
    c = C.context(journal(spark, *many), "gear", AT, limit=10)
    assert c.total == 15 and c.next_offset == 10 and c.candidates.count() == 10
    assert C.context(journal(spark, *many), "gear", AT, limit=10, offset=10).next_offset is None


def test_trace_ranks_passages_across_sources(spark):
    g = G.materialize(journal(spark, node("a", type="Model", label="brass valve"), node("b", type="Dataset", label="notes"), link("a", "b", "DERIVED_FROM")), AT)
    rows = [("a", 1, "nothing here"), ("a", 2, "the brass valve leaks"), ("b", 1, "valve"), ("b", 2, "brass brass valve valve"), ("z", 1, "brass valve")]
    got = T.search(g, spark.createDataFrame(rows, "node string, line long, text string"), "brass valve").collect()
    assert [(r["node"], r["line"]) for r in got] == [("a", 2), ("b", 2), ("b", 1)]
    assert got[0]["score"] == round(1 / 61 + 1 / 61, 9) and got[1]["score"] == round(1 / 62 + 1 / 61, 9)


UUID = "123e4567-e89b-12d3-a456-42661417400"


def test_sessions_are_found_by_path(spark):
    files = spark.createDataFrame([
        (f"file:/h/.claude/projects/-w-app/{UUID}0.jsonl", "2026-01-01T00:00:00Z", 5), (f"file:/h/.codex/sessions/2026/01/rollout-2026-01-01T00-00-00-{UUID}1.jsonl", "2026-01-02T00:00:00Z", 6),
        (f"file:/h/.grok/sessions/{UUID}2/chat_history.jsonl", "2026-01-03T00:00:00Z", 7), ("file:/h/.claude/projects/-w-app/notes.jsonl", "2026-01-03T00:00:00Z", 1), (f"file:/h/other/{UUID}3.jsonl", "2026-01-03T00:00:00Z", 1),
    ], "path string, modified string, bytes long")
    found = S.candidates(files)
    assert {(r["source"], r["id"], r["project"]) for r in found.collect()} == {("claude", f"{UUID}0", "-w-app"), ("codex", f"{UUID}1", None), ("grok", f"{UUID}2", None)}
    mine = S.of_project(found, spark.createDataFrame([("/w/app", S.project_folder("/w/app"))], "path string, folder string"))
    assert [r["id"] for r in mine.collect()] == [f"{UUID}0"]
    assert S.locate(found, f"{UUID}1")["source"] == "codex"
    for bad in ("nobody", UUID[:20]):
        with pytest.raises(LookupError):
            S.locate(found, bad)


def test_native_marks_say_how_a_session_ended(spark):
    c = lambda p, **more: {"type": "event_msg", "payload": {"type": p, **more}}
    rows = [
        ("done", "codex", 1, c("turn_aborted")), ("done", "codex", 2, c("task_complete")), ("cut", "claude", 1, {"message": {"role": "assistant", "stop_reason": "tool_use"}}),
        ("side", "claude", 1, {"isSidechain": True, "isApiErrorMessage": True}), ("fail", "codex", 1, {"type": "response_item", "payload": {"type": "function_call_output", "output": "x\nProcess exited with code 2"}}),
        ("open", "copilot", 1, {"type": "assistant.turn_start"}), ("tool", "copilot", 1, {"type": "tool.execution_complete", "data": {"success": False}}),
    ]
    events = spark.createDataFrame([(s, src, n, json.dumps(e)) for s, src, n, e in rows], "session string, source string, line long, event string")
    turns = events.selectExpr("session", "line", "'assistant' AS role").distinct()
    got = {r["session"]: (r["reasons"], r["confidence"]) for r in U.reasons(U.evidence(turns, S.outcomes(events))).collect()}
    assert got == {
        "done": (["explicit_turn_completed"], "low"), "cut": (["interrupted_or_cancelled"], "high"), "side": (["recent_activity_uncheckpointed"], "low"),
        "fail": (["unresolved_tool_failure"], "high"), "open": (["interrupted_or_cancelled"], "high"), "tool": (["unresolved_tool_failure"], "high"),
    }


def test_pickup_says_what_it_found(spark):
    found = spark.createDataFrame([("a", "2026-01-01"), ("b", "2026-01-02")], "id string, modified string")
    why = lambda *ids: spark.createDataFrame([(i, ["x"], "high") for i in ids], "session string, reasons array<string>, confidence string")
    assert S.pickup(found, why())["resolution"] == "not_found" and S.pickup(found, why("a"))["id"] == "a"
    assert S.pickup(found, why("a", "b")) == {"resolution": "ambiguous", "candidates": ["b", "a"]}
    states = {r["folder"]: r["state"] for r in S.coverage(spark, spark.createDataFrame([(".grok/sessions",)], "folder string"), "grok").collect()}
    assert states[".grok/sessions"] == "scanned" and states[".claude/projects"] == "skipped"
