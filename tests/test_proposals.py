import hashlib

import pytest
from test_context import BASE
from test_graph import AT, journal

from lorekeep.functions import config
from lorekeep.operators import context as C
from lorekeep.operators import proposals as P


def rows(spark, schema, *x):
    return spark.createDataFrame(list(x), schema)


def test_drafts_are_bound_to_their_context(spark):
    ctx = P.id_context(rows(spark, "id string, text string", ("b", "two"), ("a", "one")), most_bytes=20)
    many = rows(spark, "id string, text string", ("b", "two"), ("a", "one"), ("c", "x" * 50))
    for bad in ({"most_bytes": 20}, {"most": 2}):
        with pytest.raises(ValueError):
            P.id_context(many, **bad)
    assert [(r["evidence_id"], r["id"]) for r in ctx.collect()] == [("E1", "a"), ("E2", "b")]
    draft = rows(spark, "claim string, evidence_ids array<string>", ("c1", ["E1", "E2", "E1"]))
    assert {(r["claim"], r["id"]) for r in P.bind(draft, ctx, P.context_hash(ctx)).collect()} == {("c1", "a"), ("c1", "b")}
    with pytest.raises(ValueError):
        P.bind(draft, ctx, "other")
    with pytest.raises(ValueError):
        P.bind(rows(spark, "claim string, evidence_ids array<string>", ("c1", ["E9"])), ctx, P.context_hash(ctx))


def test_claims_need_exact_quotes(spark):
    sources = rows(spark, "source_id string, text string", ("s", "one two one"))
    q = "claim string, quotes array<struct<source_id:string,quote:string>>"
    got = {r["claim"]: r["findings"] for r in P.claim_findings(rows(spark, q, ("a", [("s", "two")]), ("b", [("s", "one"), ("x", "y")]), ("c", []), ("d", [("s", "three")])), sources).collect()}
    assert got == {"a": [], "b": ["quote_ambiguous", "source_unknown"], "c": ["nothing cited"], "d": ["quote_absent"]}


def test_assertions_stand_on_bytes(spark):
    sources = rows(spark, "source_id string, text string, role string", ("u", "é plan", "user"), ("a", "done", "assistant"))
    p = "id string, source_id string, begin int, end int, text string, role string, basis string, supersedes string"
    got = {r["id"]: r["problem"] for r in P.assertions(rows(
        spark, p, ("1", "u", 3, 7, "plan", "user", "said_by_user", None), ("2", "u", 2, 6, "plan", "user", "x", None), ("3", "a", 0, 4, "done", "assistant", "said_by_user", None), ("4", "a", 0, 9, "done", "assistant", "x", None),
        ("5", "z", 0, 1, "x", "user", "x", None), ("6", "a", 0, 4, "done", "user", "x", None), ("7", "a", 0, 4, "done", "assistant", "x", "8"), ("8", "a", 0, 4, "done", "assistant", "x", "7"), ("9", "a", 0, 4, "done", "assistant", "x", "1"),
        ("10", "a", 0, 4, "done", "assistant", "x", "77"), ("11", "a", 0, 4, "done", "assistant", "x", "11"),
    ), sources).collect()}
    assert got == {
        "1": None, "2": "span_differs", "3": "basis_unfounded", "4": "span_outside", "5": "source_unknown", "6": "role_differs", "7": "supersedes_circle", "8": "supersedes_circle", "9": None, "10": "supersedes_unknown", "11": "supersedes_circle",
    }


def test_reviews_and_expansion(spark):
    premises = rows(spark, "`case` string, premise string", ("a", "1"), ("a", "2"), ("b", "1"), ("c", "3"))
    spans = rows(spark, "premise string, stance string", ("1", "supports"), ("3", "refutes"), ("3", "supports"))
    assert {r["case"]: r["readiness"] for r in P.review(premises, spans).collect()} == {"a": "needs_more_evidence", "b": "supported_investigation", "c": "conflicting_evidence"}
    items = rows(spark, "id string, content string", ("x", "1"), ("y", "2"))
    assert [r["sha256"] for r in P.expand(items, items.where("id = 'y'"), "h", "h").collect()] == [hashlib.sha256(b"2").hexdigest()]
    with pytest.raises(ValueError):
        P.expand(items, items, "h", "i")


def test_ids_are_stable_and_unique(spark):
    pages = rows(spark, "name string, node_id string", ("a.md", "wiki:own"), ("b.md", None), ("c.md", None))
    live = rows(spark, "id string, path string", ("wiki:old", "b.md"), ("wiki:older", "b.md"))
    got = {r["name"]: r["id"] for r in P.assign_ids(pages, live).collect()}
    assert got["a.md"] == "wiki:own" and got["b.md"] == "wiki:old" and got["c.md"] == "wiki:" + hashlib.sha256(b"c.md").hexdigest()[:16]
    with pytest.raises(ValueError):
        P.assign_ids(pages.union(rows(spark, "name string, node_id string", ("d.md", "wiki:own"))), live)


def test_snapshots_discovery_registry(spark):
    good = hashlib.sha256(b"x").hexdigest()
    index = rows(spark, "task string, seq int, sha256 string", ("t", 0, "zz"), ("t", 1, good), ("u", 0, "yy"), ("v", 0, "none"))
    store = rows(spark, "sha256 string, content string", (good, "x"), ("yy", "x"))
    assert {r["task"]: r["problem"] for r in P.latest_snapshot(index, store).collect()} == {"t": None, "u": "changed", "v": "absent"}
    files = rows(spark, "path string", ("/d/Plan B.pdf",), ("/d/plan lamp.pdf",), ("/plan/x.pdf",))
    assert [r["path"] for r in P.discover(files, ["plan", "LAMP"]).collect()] == ["/d/plan lamp.pdf", "/d/Plan B.pdf"]
    p = rows(spark, "id string, label string, path string", ("a", "", None), ("b", "B", "p"))
    r = rows(spark, "id string, label string, path string", ("a", "A", "q"), ("b", "Z", "z"))
    assert {tuple(x) for x in P.with_registry(p, r).collect()} == {("a", "A", "q"), ("b", "B", "p")}


def test_context_as_text(spark):
    text = C.render(C.context(journal(spark, *BASE), "Lamp wiring", AT))
    assert text.splitlines()[:3] == ["resolution: retrieved", "- Lamp wiring (task:1) 1.00 literal_match", "project: project:lamp"] and "Use copper" in text


def test_settings(tmp_path):
    s, origin, warnings = config.merge([("machine", {"limit": 5, "nope": 1}), ("project", {"limit": 7, "budget": "many"})], {"LOREKEEP_INCLUDE_EXPIRED": "true", "LOREKEEP_LIMIT": "x", "OTHER": "1"})
    assert s["limit"] == 7 and origin["limit"] == "project" and s["include_expired"] is True and s["budget"] == 8_000
    assert warnings == ["machine: unknown key nope", "project: budget is no int", "environment: limit is no int"]
    (tmp_path / ".lorekeep").mkdir()
    (tmp_path / "a/b").mkdir(parents=True)
    assert config.resolve_root(None, {}, str(tmp_path / "a/b")) == str(tmp_path.resolve())
    assert config.resolve_root("/x", {"LOREKEEP_ROOT": "/y"}) == "/x" and config.resolve_root(None, {"LOREKEEP_ROOT": "/y"}) == "/y"
