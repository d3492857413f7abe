import json

from test_graph import AT, journal, link, node

from lorekeep.operators import graph as G
from lorekeep.operators import handoff as H
from lorekeep.sources import journal as J
from lorekeep.sources import sinks as S


def replayed(spark, events):
    rows = [(n, r["op"], r["payload"], None) for n, r in enumerate(events.collect())]
    good, bad = J.prepare(spark.createDataFrame(rows, "place long, op string, payload string, observed_utc string"))
    assert bad.count() == 0
    return G.materialize(good, "2099-01-01T00:00:00Z")


def edges(g):
    return {(r["from"], r["edge"], r["to"]) for r in g.edges.collect()}


def test_indexes_converge(spark, tmp_path):
    j = journal(spark, node("a", label="brass valve"), node("b"), link("a", "b"))
    for _ in range(2):
        S.build_indexes(j, str(tmp_path))
    counts = [spark.read.parquet(f"{tmp_path}/{t}").count() for t in ("nodes", "edges", "postings")]
    assert counts == [2, 1, 2]


def test_edges_are_checked_before_they_are_written(spark):
    nodes = spark.createDataFrame([("t", "task", None), ("p", "Project", None), ("w", "Wiki", "me"), ("d", "Dataset", None)], "id string, type string, provenance string")
    proposed = spark.createDataFrame([("t", "belongs_to", "p", None), ("p", "BELONGS_TO", "t", None), ("t", "X", "p", None), ("w", "X", "p", None), ("t", "BELONGS_TO", "gone", None), ("d", "LOCATED_AT", "s3://b", None), ("d", "LOCATED_AT", "b", None)], "`from` string, type string, `to` string, provenance string")
    good, bad = S.checked_edges(proposed, nodes)
    assert {(e["from"], e["type"], e["to"]) for e in (json.loads(r["payload"]) for r in good.collect())} == {("t", "BELONGS_TO", "p"), ("w", "X", "p"), ("d", "LOCATED_AT", "s3://b")}
    assert {(r["from"], r["to"], r["error"]) for r in bad.collect()} == {("p", "t", "illegal_pair"), ("t", "p", "missing_provenance"), ("t", "gone", "dangling_to"), ("d", "b", "dangling_to")}


def test_artifacts_are_stored_once(spark, tmp_path):
    files = lambda *f: spark.createDataFrame([(n, bytearray(c)) for n, c in f], "name string, content binary")
    store = str(tmp_path / "store")
    assert {r["name"]: r["batch"] for r in S.add_artifacts(files(("a", b"1"), ("b", b"1"), ("c", b"2")), store).collect()} == {"a": 0, "b": 0, "c": 0}
    assert {r["name"]: r["batch"] for r in S.add_artifacts(files(("d", b"2"), ("e", b"3")), store).collect()} == {"d": 0, "e": 1}
    assert spark.read.parquet(store).count() == 3


def test_logs_number_on(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([(k, f"e{k}") for k in range(n)], "place long, note string")
    path = str(tmp_path / "log")
    assert [S.append_log(rows(2), path), S.append_log(rows(3), path)] == [0, 2]
    assert sorted(r["sequence"] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4]


def test_receipts_are_mirrored(spark):
    r = spark.createDataFrame([("r1", "plan", "project:x", "Plan 1", "a/1", "h1"), ("r2", "plan", "project:x", "Plan 2", "a/2", "h2")], "id string, document string, project string, title string, path string, sha256 string")
    g = replayed(spark, S.mirror_receipts(r))
    assert g.nodes.count() == 3 and ("revision:r2", "REVISION_OF", "document:plan") in edges(g) and ("document:plan", "REFERENCES_PROJECT", "project:x") in edges(g)
    e = spark.createDataFrame([("e1", "2026-01-02", "moved", "r1", "to b")], "id string, date string, kind string, receipt string, note string")
    t = S.ledger_timeline(r.selectExpr("id", "'2026-01-01' AS date", "title"), e).collect()
    assert [(x["kind"], x["id"]) for x in t] == [("receipt", "r1"), ("receipt", "r2"), ("moved", "e1")]


def test_histories_only_grow(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "id string, sha256 string")
    got = {(r["id"], r["problem"]) for r in S.history_changes(rows(("a", "1"), ("b", "2"), ("c", "3")), rows(("a", "1"), ("b", "9"), ("d", "4"))).collect()}
    assert got == {("b", "rewritten"), ("c", "removed")}


def test_constraints_are_quoted_words(spark):
    turns = spark.createDataFrame([("s", 1, "user", "keep it under ten pages"), ("s", 2, "assistant", "ten pages")], "session string, line long, role string, content string")
    wanted = spark.createDataFrame([("s", 1, "project:x", "under ten pages"), ("s", 2, "project:x", "ten pages"), ("s", 1, "project:x", "twelve")], "session string, line long, project string, quote string")
    good, bad = S.quoted_constraints(turns, wanted)
    assert bad.count() == 2
    g = replayed(spark, S.constraint_events(good))
    (ident,) = [r["id"] for r in g.nodes.collect()]
    assert ident.startswith("constraint:x:") and edges(g) == {(ident, "BELONGS_TO", "project:x")} and g.nodes.first()["attrs"]["provenance"] == "conversation:s#1"


def test_facts_and_pages_become_nodes_with_sources(spark):
    facts = spark.createDataFrame([("k:1", "s", "decision", "use copper", 0.9), ("k:2", "s", "blocker", "no access", 0.7)], "id string, session string, kind string, text string, confidence double")
    g = replayed(spark, S.knowledge_events(facts))
    assert edges(g) == {("k:1", "DERIVED_FROM", "conversation:s"), ("k:2", "DERIVED_FROM", "conversation:s")}
    assert {r["id"]: r["attrs"]["type"] for r in g.nodes.collect()} == {"conversation:s": "Conversation", "k:1": "KnowledgeDecision", "k:2": "KnowledgeBlocker"}
    pages = spark.createDataFrame([("wiki:a", "a.md", "A", ["x", "y"]), ("wiki:b", "b.md", "B", ["x"])], "id string, name string, title string, sources array<string>")
    g = replayed(spark, S.wiki_events(pages))
    assert g.nodes.count() == 4 and len(edges(g)) == 3


def test_findings(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("z", "9")], "path string, sha256 string")
    refs = spark.createDataFrame([("p", "a", "1"), ("p", "b", "x"), ("p", "c", "1")], "page string, ref string, sha256 string")
    assert {r["ref"]: r["finding"] for r in S.verify_sources(refs, files).collect()} == {"a": "fine", "b": "drifted", "c": "broken"}
    plan = spark.createDataFrame([("a", "1", True), ("b", "x", False), ("c", "3", True)], "path string, sha256 string, keep boolean")
    assert {r["path"]: r["problem"] for r in S.finalize_plan(plan, files).collect()} == {"a": None, "b": "changed", "c": "missing", "z": "not_planned"}
    done = spark.createDataFrame([("s", "codex", "h"), ("t", "codex", "h")], "session string, source string, sha256 string")
    assert S.attestations(done, spark.createDataFrame([("s",)], "session string")).count() == 1


TURNS = [
    ("s", 1, "user", "<user_information>\nx\n</user_information>"), ("s", 2, "user", "make the plan"), ("s", 3, "assistant", "see [plan](/out/plan%20a.pdf) and /out/b.csv. It has been approved. Fine."), ("s", 4, "user", "thanks"),
]


def test_handoff(spark):
    t = spark.createDataFrame(TURNS, "session string, line long, role string, content string")
    b = H.brief(t).first()
    assert (b["request"], b["request_line"], b["answer_line"], b["answered"]) == ("thanks", 4, 3, False)
    calls = spark.createDataFrame([("s", 5, "write", "b"), ("s", 6, "write", "a"), ("s", 7, "read", "c")], "session string, line long, action string, target string")
    results = spark.createDataFrame([("s", 8, "Process exited with code 1"), ("s", 9, "Process exited with code 0"), ("s", 10, "Process exited with code 2")], "session string, line long, content string")
    d = H.digest(t, calls, results).first()
    assert (d["asked"], d["written"], d["read"], d["searched"], d["failed"], d["claims"]) == ("2,4", ["a", "b"], ["c"], None, "8,10", "3")
    found = H.deliveries(t)
    assert {r["path"] for r in found.collect()} == {"/out/plan a.pdf", "/out/b.csv"}
    assert [(r["folder"], r["files"]) for r in H.folders(found).collect()] == [("/out", ["b.csv", "plan a.pdf"])]


def test_attachments(spark):
    r = spark.createDataFrame([("s", 1, "data:image/png;base64,AAAA"), ("s", 2, "text")], "session string, line long, content string")
    kept, left = H.externalize(r)
    texts = {x["line"]: x["content"] for x in kept.collect()}
    assert texts[1].startswith("attachment:") and texts[2] == "text"
    assert [(x["content"], x["problem"]) for x in H.resolve(r, left).collect()] == [("data:image/png;base64,AAAA", None)]
    wrong = left.selectExpr("session", "line + 1 AS line", "sha256").union(left.selectExpr("session", "line + 9", "sha256"))
    assert {x["problem"] for x in H.resolve(r, wrong).collect()} == {"changed", "absent"}


def test_small_things(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(H.smallest(F.lit("臺臺"), F.lit("abcde"), F.lit("臺a"))).first()[0] == "臺a"
    j = journal(spark, node("a"), node("b"), link("a", "b"), node("a", label="x"))
    assert [r["seq"] for r in H.history_of(j, "a").collect()] == [0, 2, 3] and AT
    assert H.profile({"title": "T"}) == "# T\n\n\n\nstatus: \n"
    assert "unknown" in H.render_brief([{"id": "t", "label": "L", "status": "unknown", "projects": ["p"]}])
