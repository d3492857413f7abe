"""Every registered query of the engine and its SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import evidence_queries, graph_queries, lexical_queries, report_queries, request_queries, session_queries

_MODULES = (graph_queries, lexical_queries, session_queries, report_queries, evidence_queries, request_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
