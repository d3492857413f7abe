"""Rows of a Spark query and of its SQL, in one form."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(value):
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return "null"
    if isinstance(value, float):
        return repr(int(value)) if value == int(value) else f"{value:.9g}"
    if hasattr(value, "tolist"):
        value = value.tolist()
    return str([canonical(v) for v in value]) if isinstance(value, list) else str(value)


def rows_of(frame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(tuple(canonical(v) for v in row) for row in frame[columns].itertuples(index=False))


def run_sql(sql: str, sf: str):
    db = duckdb.connect()
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db.execute(sql).df()


def assert_agrees(spark, sf: str, query, sql: str) -> None:
    got, want = query(spark, sf).toPandas(), run_sql(sql, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
