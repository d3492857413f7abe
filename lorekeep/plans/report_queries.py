"""Queries of status, briefs, pages, ledger and health, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import reports as P
from . import derived as D
from .graph_queries import EDGES, STAMP

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_N = "(SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier)"
_E = "(SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + 2 * (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem)"


@query(f"SELECT {_N} + {_E} + (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS events, {_N} AS nodes, (SELECT count(*) FROM part) AS artifacts, {_E} AS edges")
def status_counts(spark, d):
    return P.status(D.journal(spark, d))


@query(f"""SELECT o_orderkey AS seq, strftime(o_orderdate, {STAMP}) AS observed_utc, 'node.upsert' AS op, 'order:' || o_orderkey || ' Order#:' || o_orderkey AS summary FROM orders WHERE strftime(o_orderdate, {STAMP}) LIKE '1997-03%'
UNION ALL SELECT 9000000000 + o_orderkey, strftime(o_orderdate, {STAMP}), 'edge.assert', 'customer:' || o_custkey || ' HAS_ORDER order:' || o_orderkey FROM orders WHERE strftime(o_orderdate, {STAMP}) LIKE '1997-03%'
UNION ALL SELECT 9000000000 + o_orderkey, strftime(o_orderdate, {STAMP}), 'edge.assert', 'order:' || o_orderkey || ' belongs_to customer:' || o_custkey FROM orders WHERE strftime(o_orderdate, {STAMP}) LIKE '1997-03%'""")
def timeline_month(spark, d):
    return P.timeline(D.node_events(spark, d).union(D.place_events(spark, d)), "1997-03")


@query(f"""SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, 'edge.assert' AS op, 2 * count(*) AS n, sum(2 * count(*)) OVER (ORDER BY strftime(o_orderdate, '%Y-%m-%d')) + (CASE WHEN true THEN (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) END) AS running FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') > '1995-01-01' GROUP BY day""".replace("+ (CASE WHEN true", "+ 2 * (SELECT count(*) FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') <= '1995-01-01') + (CASE WHEN true"))
def events_by_day(spark, d):
    return P.by_day(D.place_events(spark, d)).where("day > '1995-01-01'")


@query(f"""SELECT 'order:' || o_orderkey AS id, 'customer:' || o_custkey AS projects, CASE o_orderstatus WHEN 'P' THEN 'blocked' ELSE 'open' END AS status, 'Order#:' || o_orderkey AS label, strftime(o_orderdate, {STAMP}) AS updated FROM orders WHERE o_orderstatus <> 'F'""")
def task_brief(spark, d):
    """Tasks that haven't ended, with their projects."""
    g = G.materialize(D.node_events(spark, d).union(D.place_events(spark, d)), include_expired=True)
    return P.task_brief(g).withColumn("projects", F.array_join("projects", ","))


@query("""SELECT 'customer:' || o_custkey AS project, 'Tasks' AS section, string_agg('Order#:' || o_orderkey, ',' ORDER BY strftime(o_orderdate, '%Y-%m-%d'), 'Order#:' || o_orderkey) AS members FROM orders GROUP BY o_custkey""")
def project_page(spark, d):
    """Who belongs on each project's page, in order."""
    g = G.materialize(D.node_events(spark, d).union(D.place_events(spark, d)), include_expired=True)
    return P.project_pages(g).withColumn("members", F.array_join("members", ","))


@query(f"""WITH {EDGES}, loose AS (SELECT "from", "to" FROM x WHERE NOT retracted AND try_cast(substr("to", 6) AS bigint) % 10 = 0 GROUP BY ALL)
SELECT 'journal-valid' AS "check", 2 AS severity, count(*) AS problems, 'first at ' || min(event_id) AS detail FROM events WHERE event_id % 100 = 3
UNION ALL SELECT 'quarantine-list', 1, count(*), NULL FROM events WHERE event_id % 100 = 3 UNION ALL SELECT 'index-rebuildable', 0, 0, NULL
UNION ALL SELECT 'ref-integrity', CASE WHEN count(*) > 0 THEN 1 ELSE 0 END, count(*), min("from" || ' FOLLOWS_UP ' || "to") FROM loose
UNION ALL SELECT 'tap-cursor', 1, count(*), min(n_name) FROM nation WHERE n_nationkey % 2 = 1""")
def doctor(spark, d):
    """Five checks of a journal with a tenth of its parts missing, bad lines and a stale cursor."""
    from ..functions.canonical import event_id

    j = D.node_events(spark, d).where("not (get_json_object(payload, '$.id') like 'part:%0')").union(D.line_events(spark, d))
    j = j.withColumn("id", event_id(F.col("op"), F.col("payload")))
    bad = D.table(spark, d, "events").where("event_id % 100 = 3").select(F.col("event_id").alias("seq"), F.lit("{").alias("line"))
    names = D.table(spark, d, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    return P.doctor(j, bad, names.select("name"), names.where("n_nationkey % 2 = 0").select("name"))


LEDGER = """
r AS (SELECT p_partkey AS id, 'a/' || p_partkey AS path, p_type AS class, sha256(p_name) AS sha256, CASE WHEN p_partkey % 9 = 0 AND p_partkey > 0 THEN p_partkey - 1 END AS supersedes FROM part),
e AS (SELECT event_id AS sequence, event_id % 500 AS receipt, CASE WHEN event_type = 'view' THEN 'b/' || event_id END AS path, CASE WHEN event_type = 'click' THEN upper(event_type) END AS class FROM events),
m AS (SELECT receipt, arg_max(path, sequence) FILTER (path IS NOT NULL) AS path, arg_max(class, sequence) FILTER (class IS NOT NULL) AS class FROM e GROUP BY receipt),
s AS (SELECT r.id, coalesce(m.path, r.path) AS path, coalesce(m.class, r.class) AS class, r.sha256, r.id IN (SELECT supersedes FROM r WHERE supersedes IS NOT NULL) AS superseded FROM r LEFT JOIN m ON m.receipt = r.id)"""


def _ledger(spark, d):
    part = D.table(spark, d, "part")
    k = F.col("p_partkey")
    receipts = part.select(k.alias("id"), F.concat(F.lit("a/"), k).alias("path"), F.col("p_type").alias("class"), F.sha2(F.col("p_name").cast("binary"), 256).alias("sha256"), F.when((k % 9 == 0) & (k > 0), k - 1).alias("supersedes"))
    kind = F.col("event_type")
    events = D.table(spark, d, "events").select(F.col("event_id").alias("sequence"), (F.col("event_id") % 500).alias("receipt"), F.when(kind == "view", F.concat(F.lit("b/"), "event_id")).alias("path"), F.when(kind == "click", F.upper(kind)).alias("class"))
    return P.ledger_state(receipts, events), part


@query(f"WITH {LEDGER} SELECT id, path, class, sha256, superseded FROM s")
def ledger_state(spark, d):
    return _ledger(spark, d)[0]


@query(f"WITH {LEDGER}, f AS (SELECT path, CASE WHEN id % 4 = 1 THEN sha256('x') ELSE sha256 END AS now FROM s WHERE id % 5 <> 0) SELECT id, CASE WHEN superseded THEN 'superseded' WHEN now IS NULL THEN 'missing' WHEN now <> sha256 THEN 'changed' ELSE 'active' END AS finding FROM s LEFT JOIN f USING (path)")
def ledger_check(spark, d):
    state, _ = _ledger(spark, d)
    files = state.where("id % 5 <> 0").select("path", F.when(F.col("id") % 4 == 1, F.sha2(F.lit("x").cast("binary"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    return P.ledger_check(state, files)
