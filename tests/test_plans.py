import re

from lorekeep.operators import graph as G
from lorekeep.plans import derived as D
from lorekeep.plans.registry import QUERIES


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_replay_reads_and_shuffles_little(spark, sf):
    plan = plan_of(QUERIES["journal_nodes_latest"](spark, sf))
    assert "props" not in plan and "max_by" in plan and "partial_max_by" in plan


def test_retractions_meet_assertions_in_an_equality_join(spark, sf):
    plan = plan_of(G.replay_edges(D.line_events(spark, sf)))
    assert re.search("SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin", plan) and "NestedLoop" not in plan


def test_only_requested_lines_of_text_leave_the_scan(spark, sf):
    plan = plan_of(QUERIES["tail_lines"](spark, sf))
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string>" in plan


def test_sql_only_operators_stay_in_the_jvm(spark, sf):
    for name in ("edges_as_of", "bm25_topk", "decisions", "superseded_reads", "unfinished_reasons", "task_brief", "readiness"):
        assert not re.search("Python|Pandas|Arrow", plan_of(QUERIES[name](spark, sf))), name
