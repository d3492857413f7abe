"""Queries over the replayed graph, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.canonical import event_id
from ..functions.text import edge_kind, is_calendar_stamp, is_canonical_stamp, is_location, node_kind
from ..functions.vocabulary import EDGE_KINDS, NODE_KINDS, TRIPLES, URI_EDGES, URI_NODES
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators.lineage import settle
from . import derived as D

AS_OF = "1998-06-15T00:00:00Z"
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


STAMP = "'%Y-%m-%dT%H:%M:%SZ'"
EDGES = f"""
e AS (SELECT 10000000000 + l_orderkey * 10 + l_linenumber AS seq, l_orderkey, l_partkey, strftime(l_shipdate, {STAMP}) AS valid_from,
        CASE WHEN l_linenumber % 2 = 0 THEN strftime(l_shipdate + INTERVAL 365 DAY, {STAMP}) END AS valid_until, l_returnflag FROM lineitem),
r AS (SELECT l_orderkey, l_partkey, max(10000000000 + l_orderkey * 10 + 5) AS retract_seq FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
x AS (SELECT seq, 'order:' || l_orderkey AS "from", 'part:' || l_partkey AS "to", valid_from, valid_until, coalesce(retract_seq > seq, false) AS retracted FROM e LEFT JOIN r USING (l_orderkey, l_partkey))
"""


@query(f"SELECT 'user:' || user_id AS id, arg_max(event_type, event_id) AS status, max(strftime(ts, {STAMP})) AS observed_utc FROM events GROUP BY user_id")
def journal_nodes_latest(spark, d):
    """Field last-wins over repeated upserts."""
    g = G.Graph(G.replay_nodes(D.user_events(spark, d)), None)
    return g.columns("status").select("id", "status", "observed_utc")


@query(f"""SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS users FROM (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1) GROUP BY 1""")
def journal_observed_max(spark, d):
    """Nodes by the day that they were last seen."""
    return G.replay_nodes(D.user_events(spark, d)).groupBy(F.substring("observed_utc", 1, 10).alias("day")).agg(F.count("*").alias("users"))


@query(f"WITH {EDGES} SELECT \"from\", \"to\", count(*) AS n_edges, count_if(retracted) AS n_retracted FROM x GROUP BY ALL")
def edges_retracted(spark, d):
    """A retraction hits earlier assertions only; a later one lives again."""
    e = G.replay_edges(D.line_events(spark, d))
    return e.groupBy("from", "to").agg(F.count("*").alias("n_edges"), F.count_if("retracted").alias("n_retracted"))


@query(f"WITH {EDGES} SELECT seq, \"from\", \"to\", valid_from, valid_until, retracted FROM x WHERE valid_from <= '{AS_OF}' AND (valid_until IS NULL OR '{AS_OF}' <= valid_until)")
def edges_as_of(spark, d):
    """Edges whose validity holds at an instant, both ends included."""
    return G.valid_at(G.replay_edges(D.line_events(spark, d)), AS_OF).select("seq", "from", "to", "valid_from", "valid_until", "retracted")


@query(f"WITH {EDGES} SELECT substr(valid_from, 1, 7) AS month, valid_until IS NULL AS open_ended, count(*) AS n FROM x GROUP BY ALL")
def edges_include_expired(spark, d):
    """Without the validity filter every assertion is there."""
    e = G.materialize(D.line_events(spark, d), include_expired=True).edges
    return e.groupBy(F.substring("valid_from", 1, 7).alias("month"), F.col("valid_until").isNull().alias("open_ended")).agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey, sha256('{"v":"journal/v1","op":"node.upsert","payload":{"id":"nation:' || n_nationkey || '","label":"' || n_name || '","region":' || n_regionkey || '}}') AS id FROM nation""")
def event_id_hash(spark, d):
    """Ids are hashes of canonical JSON: sorted keys, without the time of observation."""
    n = D.table(spark, d, "nation")
    payload = F.to_json(F.struct(F.col("n_regionkey").alias("region"), F.col("n_name").alias("label"), F.lit("2024-01-01T00:00:00Z").alias("observed_utc"), F.concat(F.lit("nation:"), "n_nationkey").alias("id")))
    return n.select("n_nationkey", event_id(F.lit("node.upsert"), payload).alias("id"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in rows)


_KINDS = ("conversation", "TASK", "Decision", "experiment", "Dataset", "model", "Artifact", "project", "Product", "Wiki")
_EDGES = ("belongs_to", "FOLLOWS_UP", "Supports", "EVALUATES", "DISCUSSED_IN", "DERIVED_FROM", "SUPERSEDES", "LOCATED_AT", "ORIGINATED_AT", "CONTAINS", "PART_OF", "INFORMS", "MENTIONS")
_FAR = tuple((k, None) for k in _KINDS) + ((None, "/data/x"), (None, "s3://b/k"), (None, "relative"), (None, ""))


@query(f"""
WITH k(raw) AS (VALUES {_values((k,) for k in _KINDS)}), ed(raw) AS (VALUES {_values((e,) for e in _EDGES)}), far(raw, uri) AS (VALUES {_values(_FAR)}), pr(provenance) AS (VALUES ('hand'), (' '), (NULL)),
core(name) AS (VALUES {_values((k,) for k in NODE_KINDS)}), cedge(name) AS (VALUES {_values((e,) for e in EDGE_KINDS)}), legal(a, e, b) AS (VALUES {_values(TRIPLES)}),
c AS (SELECT coalesce(c1.name, k.raw) AS from_kind, coalesce(ce.name, ed.raw) AS edge, CASE WHEN far.raw IS NOT NULL THEN coalesce(c2.name, far.raw) END AS to_kind, uri, provenance,
        c1.name IS NULL OR ce.name IS NULL OR (far.raw IS NOT NULL AND c2.name IS NULL) AS custom
      FROM k CROSS JOIN ed CROSS JOIN far CROSS JOIN pr LEFT JOIN core c1 ON lower(c1.name) = lower(k.raw) LEFT JOIN cedge ce ON ce.name = upper(ed.raw) LEFT JOIN core c2 ON lower(c2.name) = lower(far.raw))
SELECT from_kind, edge, to_kind, uri, provenance, CASE
  WHEN custom AND coalesce(trim(provenance), '') = '' THEN 'missing_provenance'
  WHEN to_kind IS NULL AND edge NOT IN ({", ".join(f"'{e}'" for e in URI_EDGES)}) THEN 'illegal_pair'
  WHEN to_kind IS NULL AND NOT (uri LIKE '/%' OR uri LIKE '%://%') THEN 'bad_uri'
  WHEN custom THEN NULL
  WHEN to_kind IS NULL AND from_kind NOT IN ({", ".join(f"'{n}'" for n in URI_NODES)}) THEN 'illegal_pair'
  WHEN to_kind IS NOT NULL AND NOT EXISTS (SELECT 1 FROM legal WHERE a = from_kind AND e = edge AND b = to_kind) THEN 'illegal_pair' END AS error
FROM c""")
def adjacency_validate(spark, d):
    """Every kind with every edge and far end, with and without provenance."""
    one = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    rows = one([(k, e, f, u, p) for k in _KINDS for e in _EDGES for f, u in _FAR for p in ("hand", " ", None)], "f string, e string, t string, uri string, provenance string")
    rows = rows.select(node_kind(F.col("f")).alias("from_kind"), edge_kind(F.col("e")).alias("edge"), F.when(F.col("t").isNotNull(), node_kind(F.col("t"))).alias("to_kind"), "uri", "provenance")
    return rows.withColumn("error", G.triple_error(F.col("from_kind"), F.col("edge"), F.col("to_kind"), F.col("uri"), F.col("provenance")))


_STAMPS = ("2026-01-01T00:00:00Z", "2026-02-30T00:00:00Z", "2026-01-01T00:00:00+08:00", "2026-01-01", "2024-02-29T23:59:59Z", "2023-02-29T23:59:59Z", "2026-1-01T00:00:00Z", "")


@query(f"""
WITH s AS (SELECT strftime(ts, {STAMP}) AS s FROM events UNION ALL SELECT props FROM events UNION ALL SELECT * FROM (VALUES {_values((s,) for s in _STAMPS)}))
SELECT regexp_full_match(s, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z') AS canonical,
       regexp_full_match(s, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z') AND try_strptime(s, {STAMP}) IS NOT NULL AS calendar, count(*) AS n FROM s GROUP BY ALL""")
def timestamp_canonical(spark, d):
    """The fixed-width shape, and the days that exist."""
    e = D.table(spark, d, "events")
    s = e.select(D.stamp(F.col("ts")).alias("s")).union(e.select("props")).union(spark.createDataFrame([(x,) for x in _STAMPS], "s string"))
    return s.groupBy(is_canonical_stamp(F.col("s")).alias("canonical"), is_calendar_stamp(F.col("s")).alias("calendar")).agg(F.count("*").alias("n"))


@query("SELECT url LIKE '/%' OR url LIKE '%://%' AS location, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, count(*) AS n FROM (SELECT url FROM pages UNION ALL SELECT regexp_replace(url, '^[a-z]+:/', '') FROM pages UNION ALL SELECT substr(url, 9) FROM pages) GROUP BY ALL")
def uri_shape(spark, d):
    """What counts as a location."""
    p = D.table(spark, d, "pages")
    u = p.select("url").union(p.select(F.regexp_replace("url", "^[a-z]+:/", ""))).union(p.select(F.substring("url", 9, 10_000)))
    return u.groupBy(is_location(F.col("url")).alias("location"), F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme")).agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT 'project:' || c_custkey AS id, c_name AS label, 'team/' || c_nationkey || '/' || c_custkey AS path FROM customer),
q AS (SELECT 'Project:' || c_custkey AS input FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_name || '/' FROM customer WHERE c_custkey % 5 = 1
      UNION ALL SELECT '/home/u/workspace/team/' || c_nationkey || '/' || c_custkey FROM customer WHERE c_custkey % 5 = 2 UNION ALL SELECT c_mktsegment FROM customer),
k AS (SELECT DISTINCT input, regexp_replace(lower(rtrim(trim(input), '/')), '^.*?/workspace/', '') AS query FROM q),
b AS (SELECT input, query, regexp_replace(query, '^(project:|workspace:|p:)', '') AS bare FROM k),
h AS (SELECT input, 0 AS rank, id FROM b JOIN p ON query = id UNION ALL SELECT input, 1, id FROM b JOIN p ON 'project:' || bare = id UNION ALL SELECT input, 1, id FROM b JOIN p ON bare = path
      UNION ALL SELECT input, 2, id FROM b JOIN p ON query = lower(label) UNION ALL SELECT input, 3, id FROM b JOIN p ON 'project:' || bare = id)
SELECT input, rank, array_to_string(list_sort(list_distinct(list(id))), ',') AS candidates FROM h WHERE rank = (SELECT min(rank) FROM h h2 WHERE h2.input = h.input) GROUP BY input, rank""")
def resolve_project(spark, d):
    """Human references to projects, by falling precision."""
    c = D.table(spark, d, "customer")
    projects = c.select(F.concat(F.lit("project:"), "c_custkey").alias("id"), F.col("c_name").alias("label"), F.concat_ws("/", F.lit("team"), "c_nationkey", "c_custkey").alias("path"))
    mine = lambda k: c.where(F.col("c_custkey") % 5 == k)
    inputs = mine(0).select(F.concat(F.lit("Project:"), "c_custkey").alias("input")).union(mine(1).select(F.concat("c_name", F.lit("/")))).union(
        mine(2).select(F.concat(F.lit("/home/u/workspace/team/"), "c_nationkey", F.lit("/"), "c_custkey"))).union(c.select("c_mktsegment")).distinct()
    return G.resolve_projects(projects, inputs).select("input", "rank", F.array_join("candidates", ",").alias("candidates"))


NODES = """
nodes AS (SELECT 'region:' || r_regionkey AS id, 'Region' AS kind, r_name AS label, '' AS body FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', n_name, '' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'Project', c_name, c_mktsegment FROM customer UNION ALL SELECT 'order:' || o_orderkey, 'Task', 'Order#:' || o_orderkey, o_orderpriority FROM orders
  UNION ALL SELECT 'part:' || p_partkey, 'Artifact', p_name, p_type FROM part UNION ALL SELECT 'supplier:' || s_suppkey, 'Product', s_name, '' FROM supplier),
links AS (SELECT 'region:' || n_regionkey AS a, 'nation:' || n_nationkey AS b FROM nation UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') <= 'AT' UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') <= 'AT'
  UNION ALL SELECT DISTINCT "from", "to" FROM x WHERE NOT retracted AND valid_from <= 'AT' AND (valid_until IS NULL OR 'AT' <= valid_until))
""".replace("AT'", f"{AS_OF}'").replace("'AT", f"'{AS_OF}")
BFS = """
walk AS (SELECT id, 0 AS depth FROM seeds UNION SELECT b, depth + 1 FROM walk JOIN links ON a = id JOIN nodes n ON n.id = b WHERE depth < 3),
reached AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)
"""


@query("SELECT id, kind FROM (" + f"WITH {EDGES}, {NODES} SELECT id, kind, label FROM nodes) WHERE contains(id, ':7') OR contains(label, ':7') OR contains(id, 'red') OR contains(label, 'red')")
def substring_seeds(spark, d):
    """Nodes whose id or label holds the words as they are."""
    nodes = G.Graph(G.replay_nodes(D.node_events(spark, d)), None).columns("type", "label")
    return R.substring_seeds(nodes, ":7").union(R.substring_seeds(nodes, "red")).distinct().join(nodes, "id").select("id", node_kind(F.col("type")).alias("kind"))


@query(f"WITH RECURSIVE {EDGES}, {NODES}, seeds AS (SELECT id FROM nodes WHERE label = 'ASIA' OR id = 'customer:7'), {BFS} SELECT id, depth FROM reached")
def bfs_depth3(spark, d):
    """Forward steps over live, legal edges at an instant."""
    g = G.materialize(D.journal(spark, d), AS_OF)
    nodes = settle(g.columns("label", "type", "provenance"))
    return G.walk(nodes, g.edges, nodes.where("label = 'ASIA' or id = 'customer:7'").select("id"), 3)


@query(f"""WITH RECURSIVE {EDGES}, {NODES}, seeds AS (SELECT id FROM nodes WHERE contains(id, 'NATION_3') OR contains(label, 'NATION_3')), {BFS}
SELECT id AS node_id, kind, label, CASE WHEN body = '' THEN label ELSE label || ' ' || substr(body, 1, 200) END AS excerpt, round(1.0 / (1 + depth), 6) AS score, 'graph' AS why
FROM reached JOIN nodes USING (id) ORDER BY depth, id LIMIT 20""")
def hits_query(spark, d):
    """The whole hits view: replay, seeds, three steps, ranking, limit. The flagship."""
    return R.hits(D.journal(spark, d), "NATION_3", as_of=AS_OF).hits


WORDS = """
txt AS (SELECT id, kind, label, body, concat_ws(' ', CASE WHEN label <> '' THEN label END, CASE WHEN body <> '' THEN body END) AS text FROM nodes),
tm AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM txt), tl AS (SELECT id, count(*) AS len FROM tm GROUP BY id),
st AS (SELECT (SELECT count(*) FROM nodes) AS n, greatest((SELECT count(*) FROM tm) / (SELECT count(*) FROM nodes), 1.0) AS mean),
tf AS (SELECT id, term, count(*) AS tf FROM tm WHERE term IN ('gizmo', '3', 'urgent') GROUP BY ALL), td AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
best AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score FROM tf JOIN td USING (term) JOIN tl USING (id) CROSS JOIN st GROUP BY id ORDER BY score DESC, id LIMIT 20),
"""


@query(f"""WITH RECURSIVE {EDGES}, {NODES}, {WORDS} seeds AS (SELECT id FROM nodes WHERE contains(id, 'gizmo 3 urgent') OR contains(label, 'gizmo 3 urgent') UNION SELECT id FROM best), {BFS}
SELECT id AS node_id, kind, label, CASE WHEN body = '' THEN label ELSE label || ' ' || substr(body, 1, 200) END AS excerpt, round(1.0 / (1 + depth), 6) AS score, 'graph' AS why
FROM reached JOIN nodes USING (id) ORDER BY depth, id LIMIT 60""")
def hits_words(spark, d):
    """The hits view with seeds by words: the best twenty nodes by BM25, then three steps."""
    return R.hits(D.journal(spark, d), "gizmo 3 urgent", as_of=AS_OF, limit=60, words=True).hits


@query(f"""WITH {EDGES}, ids AS (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0)
SELECT "from", 'FOLLOWS_UP' AS edge, "to", 'to' AS missing FROM x WHERE NOT retracted AND try_cast(substr("to", 6) AS bigint) NOT IN (SELECT p_partkey FROM ids) GROUP BY ALL""")
def dangling_edges(spark, d):
    """Live edges to parts that a tenth of the nodes' absence leaves open."""
    edges = G.replay_edges(D.line_events(spark, d))
    nodes = D.table(spark, d, "part").where("p_partkey % 10 <> 0").select(F.concat(F.lit("part:"), "p_partkey").alias("id"))
    return G.dangling(edges, nodes.union(D.table(spark, d, "orders").select(F.concat(F.lit("order:"), "o_orderkey"))))


@query("""
WITH RECURSIVE l AS (SELECT 'part:' || p_partkey AS a, 'part:' || (p_partkey // 3) AS b FROM part WHERE p_partkey > 0),
w AS (SELECT 'part:' || p_partkey AS root, 'part:' || p_partkey AS id, 0 AS depth FROM part WHERE p_partkey % 50 = 0 UNION SELECT root, b, depth + 1 FROM w JOIN l ON a = id)
SELECT root, id, min(depth) AS depth FROM w GROUP BY ALL""")
def dependency_closure(spark, d):
    """Everything that stated roots depend on, at its least distance."""
    part = D.table(spark, d, "part")
    links = part.where("p_partkey > 0").select(F.concat(F.lit("part:"), "p_partkey").alias("from"), F.concat(F.lit("part:"), F.expr("p_partkey div 3")).alias("to"))
    return G.closure(part.where("p_partkey % 50 = 0").select(F.concat(F.lit("part:"), "p_partkey").alias("id")), links)


