import pytest
from compare import assert_agrees

import __spark_entry__ as entry
from lorekeep.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, sf, name):
    assert_agrees(spark, sf, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_codecs_give_all_pages_back(spark, sf):
    rows = QUERIES["codec_roundtrip"](spark, sf).collect()
    assert all(r["same"] for r in rows)
    assert sum(r["coded"] for r in rows) < sum(r["plain"] for r in rows)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
