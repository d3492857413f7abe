"""Edge semantics of replay, and the hits view on small journals."""

import json
import random

import pytest

from lorekeep.operators import evidence as E
from lorekeep.operators import graph as G
from lorekeep.operators import retrieval as R

AT = "2026-03-01T00:00:00Z"


def journal(spark, *events, start="2026-01-01T00:00:00Z"):
    rows = [(i, f"e{i}", e[2] if len(e) > 2 else start, e[0], json.dumps(e[1])) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, "seq long, id string, observed_utc string, op string, payload string")


def node(i, **fields):
    return ("node.upsert", {"id": i, **fields})


def link(a, b, kind="FOLLOWS_UP", **fields):
    return ("edge.assert", {"from": a, "to": b, "type": kind, **fields})


def retract(a, b, kind="FOLLOWS_UP"):
    return ("edge.retract", {"from": a, "to": b, "type": kind})


def attrs(g):
    return {r["id"]: r["attrs"] for r in g.nodes.collect()}


def test_fields_are_last_wins_and_null_is_a_value(spark):
    g = G.materialize(journal(spark, node("t:1", label="a", status="open"), node("t:1", label="b", body=None), node("t:1", status=None)), AT)
    assert attrs(g)["t:1"] == {"id": "t:1", "label": "b", "status": None, "body": None}


def test_observed_is_the_latest_of_event_and_payload(spark):
    g = G.materialize(journal(spark, ("node.upsert", {"id": "n", "observed_utc": "2027-01-01T00:00:00Z"}, "2026-05-01T00:00:00Z"), ("node.upsert", {"id": "n"}, "2026-06-01T00:00:00Z")), AT)
    assert g.nodes.first()["observed_utc"] == "2027-01-01T00:00:00Z"


def test_retraction_hits_earlier_assertions_only(spark):
    g = G.materialize(journal(spark, link("a", "b"), retract("a", "b"), link("a", "b")), AT, include_expired=True)
    assert [(r["seq"], r["retracted"]) for r in g.edges.orderBy("seq").collect()] == [(0, True), (2, False)]


def test_retraction_does_not_depend_on_the_instant(spark):
    late = ("edge.retract", {"from": "a", "to": "b", "type": "follows_up"}, "2030-01-01T00:00:00Z")
    g = G.materialize(journal(spark, link("a", "b"), late), AT)
    assert g.edges.first()["retracted"]


@pytest.mark.parametrize("at,seen", [("2025-12-31T23:59:59Z", False), ("2026-01-01T00:00:00Z", True), ("2026-02-01T00:00:00Z", True), ("2026-02-01T00:00:01Z", False)])
def test_validity_includes_both_ends(spark, at, seen):
    g = G.materialize(journal(spark, link("a", "b", valid_until="2026-02-01T00:00:00Z")), at)
    assert (g.edges.count() == 1) == seen


def test_times_in_another_shape_drop_the_edge(spark):
    events = [link("a", "b", valid_from="2026-01-01T00:00:00+08:00"), link("a", "c", valid_until="2026-1-1"), link("a", "d", valid_from="")]
    assert [r["to"] for r in G.materialize(journal(spark, *events), AT).edges.collect()] == ["d"]


def test_broken_and_unknown_events_are_ignored(spark):
    g = G.materialize(journal(spark, ("config.set", {"key": "x"}), ("node.upsert", {"label": "no id"}), ("edge.assert", {"from": "a"}), node("n")), AT)
    assert list(attrs(g)) == ["n"] and g.edges.count() == 0


def test_empty_journal(spark):
    g = G.materialize(journal(spark), AT)
    assert g.nodes.count() == 0 and g.edges.count() == 0
    assert R.hits(journal(spark), "x", AT).hits.count() == 0


def hits(spark, q, *events, **options):
    return [(r["node_id"], r["kind"], r["score"], r["excerpt"]) for r in R.hits(journal(spark, *events), q, AT, **options).hits.collect()]


def test_hits_go_forward_with_falling_scores(spark):
    chain = [node(f"t:{i}", type="task", label=f"step {i}", body=f"body {i}") for i in range(6)] + [link(f"t:{i}", f"t:{i + 1}") for i in range(5)]
    assert hits(spark, "step 1", *chain) == [("t:1", "Task", 1.0, "step 1 body 1"), ("t:2", "Task", 0.5, "step 2 body 2"), ("t:3", "Task", 0.333333, "step 3 body 3"), ("t:4", "Task", 0.25, "step 4 body 4")]


def test_illegal_and_dangling_edges_are_not_walked(spark):
    events = [node("m", type="Model", label="seed"), node("p", type="Project"), link("m", "p", "BELONGS_TO"), link("m", "gone", "DERIVED_FROM")]
    assert [h[0] for h in hits(spark, "seed", *events)] == ["m"]


def test_custom_edges_need_provenance_which_the_source_may_lend(spark):
    events = [node("w", type="Wiki", label="seed", provenance="me"), node("x", type="Wiki"), node("y", type="Wiki"), link("w", "x", "MENTIONS"), link("x", "y", "MENTIONS")]
    assert [h[:2] for h in hits(spark, "seed", *events)] == [("w", "Wiki"), ("x", "Wiki")]


def test_limit_and_warnings(spark):
    events = [node(f"t:{i:03}", type="Task", label="same") for i in range(120)]
    out = R.hits(journal(spark, *events), "same", AT, limit=150, quarantined=True)
    assert out.hits.count() == 100 and out.warnings == ["truncated", "quarantined_skipped"]


def test_words_seed_nodes_too(spark):
    events = [node("d:1", type="Decision", label="x", summary=["The 部署 plan", "second"]), node("d:2", type="Decision", label="y", aliases="other")]
    assert [h[0] for h in hits(spark, "部署", *events, words=True)] == ["d:1"]


def test_cycles_end(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "`from` string, `to` string")
    got = {(r["id"], r["depth"]) for r in G.closure(spark.createDataFrame([("a",)], "id string"), links).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}


def test_histories_longer_than_64_steps_keep_their_ancestors(spark):
    """Two branches of 35 and 70 supersessions from one decision: only the whole closure sees that they compete."""
    chains = [["root", *(f"{side}{k:02}" for k in range(n))] for side, n in (("a", 35), ("b", 70))]
    old = {new: before for chain in chains for before, new in zip(chain, chain[1:], strict=False)}
    history = spark.createDataFrame([("t", i, [old[i]] if i in old else []) for i in sorted({x for c in chains for x in c})], "task string, id string, supersedes array<string>")
    up = {(r["id"], r["ancestor"]) for r in E.ancestors(history, "supersedes").collect()}
    assert up == {(c[k], c[j]) for c in chains for k in range(len(c)) for j in range(k)}
    assert [tuple(r) for r in E.competing(history).collect()] == [("t", "a34", "b69")]


def test_competing_branches_keep_a_row_a_decision_not_one_an_ancestor(spark, monkeypatch):
    """200 branches off one history of 400 decisions: all pairs of them, and no step holds more rows than there are decisions."""
    held = []

    def counted(df, settle=G.settle):
        held.append((df := settle(df)).count())
        return df

    monkeypatch.setattr(G, "settle", counted)
    monkeypatch.setattr(E, "PAIR_BLOCK", 7, raising=False)
    main = {f"d{k}": [f"d{k - 1}"] if k else [] for k in range(400)}
    history = spark.createDataFrame([("t", *x) for x in (main | {f"b{k}": [f"d{2 * k}"] for k in range(199)}).items()], "task string, id string, supersedes array<string>")
    ends = sorted(["d399", *(f"b{k}" for k in range(199))])
    got = [tuple(r) for r in E.competing(history).collect()]
    assert sorted(got) == [("t", a, b) for n, a in enumerate(ends) for b in ends[n + 1 :]]
    assert max(held) <= history.count()


def test_competing_branches_by_all_their_ancestors(spark):
    """Merges, other tasks' decisions and cycles, against the whole closure."""
    for seed in range(3):
        rng = random.Random(seed)
        rows = [(f"t{k % 2}", f"d{k}", [f"d{rng.randrange(k)}" for _ in range(rng.choice((0, 1, 1, 2)) if k else 0)]) for k in range(60)]
        rows += [("t0", "x0", ["x1"]), ("t1", "x1", ["x2"]), ("t1", "x2", ["x0", "d9"] if seed == 1 else ["x0"]), ("t0", "y", ["x1", "d3"]), ("t0", "z", ["x2"]), ("t1", "d50", [None])]
        history = spark.createDataFrame(rows, "task string, id string, supersedes array<string>")
        up = {}
        for r in E.ancestors(history, "supersedes").collect():
            up.setdefault(r["id"], set()).add(r["ancestor"])
        now = sorted({(r["task"], r["id"]) for r in E.current_decisions(history).collect()})
        want = [(t, a, b) for t, a in now for u, b in now if t == u and a < b and up.get(a, set()) & up.get(b, set())]
        assert sorted(tuple(r) for r in E.competing(history).collect()) == want


def test_a_bound_on_steps_holds_where_it_is_asked_for(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(9)], "`from` long, `to` long")
    assert G.closure(spark.createDataFrame([(0,)], "id long"), links, 4).count() == 5
