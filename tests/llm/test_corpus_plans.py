import re

import pytest

from lorekeep.llm import queries

NATIVE = ("op3_exact_dedup", "op9_host_reputation")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_native_operators_run_no_python(spark, sf, name):
    plan = plan_of(queries.QUERIES[name](spark, sf))
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op9_host_reputation"}))
def test_no_cross_joins(spark, sf, name):
    """One row of strengths is all that op9 crosses with anything."""
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan_of(queries.QUERIES[name](spark, sf)))


def test_scans_read_needed_columns_only(spark, sf):
    plan = plan_of(queries.QUERIES["op1_personal_data"](spark, sf))
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan)
    pages = plan_of(queries.QUERIES["op9_host_reputation"](spark, sf))
    assert "html" not in pages
