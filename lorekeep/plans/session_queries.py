"""Queries over transcripts, sessions and what they say, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import extract as X
from ..operators import sessions as S
from ..operators import turns as T
from . import derived as D

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


TURNS = "t AS (SELECT conv_id AS session, turn + 1 AS line, role, coalesce(text, '') AS content FROM conversations)"
SPICED = f"u AS (SELECT conv_id AS session, turn + 1 AS line, role, {listed(D.PHRASES)}[((conv_id + turn + 1) % {len(D.PHRASES)}) + 1] || coalesce(text, '') AS content, lower({listed(D.PHRASES)}[((conv_id + turn + 1) % {len(D.PHRASES)}) + 1] || coalesce(text, '')) AS low FROM conversations)"


def anyof(text: str, words) -> str:
    return f"len(list_filter({listed(words)}, lambda m: contains({text}, m))) > 0"


def firstof(text: str, words) -> str:
    return f"list_filter({listed(words)}, lambda m: contains({text}, m))[1]"


def cut(s: str, most: int) -> str:
    """Text cut by bytes, in SQL: the longest start whose bytes fit."""
    return f"CASE WHEN strlen({s}) <= {most} THEN {s} ELSE left({s}, list_max(list_filter(range({max(0, most // 4 - 3)}, {most - 2}), lambda n: strlen(left({s}, n)) <= {most - 3}))::int) || '...' END"


@query(f"WITH {TURNS} SELECT session, line, role, content FROM t WHERE role IN ('user', 'assistant') AND trim(content) <> ''")
def dialogue_view(spark, d):
    return T.dialogue(D.turns(spark, d))


@query(f"WITH {TURNS} SELECT session, line, role, CASE WHEN length(content) <= 120 THEN content ELSE substr(content, 1, 60) || '…' || right(content, 60) END AS preview, length(content) AS chars, length(content) > 120 AS truncated FROM t")
def index_view(spark, d):
    return T.index_view(D.turns(spark, d))


@query(f"WITH {TURNS}, n AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY session) AS total FROM t WHERE line > 1 WINDOW w AS (PARTITION BY session ORDER BY line)), p AS (SELECT * FROM n WHERE n <= 3) SELECT session, line, role, CASE WHEN total > 3 THEN max(line) OVER (PARTITION BY session) END AS next_offset FROM p")
def page_next_offset(spark, d):
    """Three rows after the first, and where the next page begins."""
    return T.page(D.turns(spark, d), 1, 3).select("session", "line", "role", "next_offset")


@query(f"WITH {TURNS} SELECT session, line, EXISTS (SELECT 1 FROM t t2 WHERE t2.session = w.session AND t2.line = w.line) AS there FROM (SELECT session, unnest([1, 4, 9]) AS line FROM (SELECT DISTINCT session FROM t)) w")
def exact_lines(spark, d):
    """Stated lines of every session, and which of them are absent."""
    t = D.turns(spark, d)
    wanted = t.select("session").distinct().select("session", F.explode(F.array(*(F.lit(n).cast("long") for n in (1, 4, 9)))).alias("line"))
    there, absent = T.exact_lines(t, wanted)
    return there.select("session", "line", F.lit(True).alias("there")).union(absent.select("session", "line", F.lit(False)))


@query(f"WITH {TURNS} SELECT session, line, role FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY line DESC) AS b FROM t) WHERE b <= 3")
def tail_lines(spark, d):
    return T.tail(D.turns(spark, d), 3).select("session", "line", "role")


@query(f"WITH {TURNS} SELECT session, line, bytes FROM (SELECT *, sum(strlen(content)) OVER (PARTITION BY session ORDER BY line) AS bytes, row_number() OVER (PARTITION BY session ORDER BY line) AS n FROM t) WHERE bytes <= 2000 AND n <= 4")
def bounded_scan(spark, d):
    return T.bounded_scan(D.turns(spark, d), 2000, 4).select("session", "line", "bytes")


@query(f"WITH {TURNS}, l AS (SELECT DISTINCT session, line, line - row_number() OVER (PARTITION BY session ORDER BY line) AS i FROM (SELECT DISTINCT session, line FROM t WHERE (session + line) % 4 <> 0)), s AS (SELECT session, min(line) AS lo, max(line) AS hi FROM l GROUP BY session, i) SELECT session, string_agg(CASE WHEN lo = hi THEN lo::varchar ELSE lo || '-' || hi END, ',' ORDER BY lo) AS ranges FROM s GROUP BY session")
def line_ranges(spark, d):
    return T.line_ranges(D.turns(spark, d).where("(session + line) % 4 <> 0"))


@query("WITH e AS (SELECT user_id AS session, event_id AS line, event_type, lag(event_type) OVER w AS b, lag(event_id) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT session, line, p AS dispatch FROM e WHERE event_type = 'view' AND b = 'click'")
def adjacent_dispatch(spark, d):
    """Results that follow right after their dispatch."""
    role = F.when(F.col("event_type") == "click", "tool_dispatch").when(F.col("event_type") == "view", "tool").otherwise("other")
    return T.adjacent_dispatch(D.table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("line"), role.alias("role")))


@query("""WITH e AS (SELECT user_id AS session, event_id AS line, event_type, 'f' || event_id % 5 AS target, value < 3 AS is_error, max(event_id) OVER (PARTITION BY user_id) AS last FROM events),
r AS (SELECT e.*, (SELECT min(line) FROM e w WHERE w.session = e.session AND w.target = e.target AND w.event_type = 'click' AND w.line > e.line) AS nw, (SELECT min(line) FROM e w WHERE w.session = e.session AND w.target = e.target AND w.event_type = 'view' AND w.line > e.line) AS nr FROM e WHERE event_type = 'view' AND NOT is_error AND line <= last - 4)
SELECT session, line, 'superseded_read' AS rule, target, nw AS by_line FROM r WHERE nw IS NOT NULL UNION ALL SELECT session, line, 'duplicate_read', target, nr FROM r WHERE nw IS NULL AND nr IS NOT NULL
UNION ALL SELECT session, line, 'empty_search', target, NULL FROM e WHERE event_type = 'error' AND NOT is_error AND line <= last - 4 AND line % 3 = 0""")
def superseded_reads(spark, d):
    """Tool outputs that later work made stale: views read, clicks write, errors search in vain every third time."""
    kind = F.col("event_type")
    action = F.when(kind == "view", "read").when(kind == "click", "write").when(kind == "error", "search")
    content = F.when(F.col("event_id") % 3 == 0, "Found 0 results.").otherwise("a.py:1: x")
    e = D.table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("line"), F.col("event_id").alias("call_line"), action.alias("action"), F.concat(F.lit("f"), F.col("event_id") % 5).alias("target"), content.alias("content"), (F.col("value") < 3).alias("is_error"))
    newest = D.table(spark, d, "events").groupBy(F.col("user_id").alias("session")).agg(F.max("event_id").alias("last"))
    return T.prune_decisions(e.where("action in ('read', 'search')"), e.where("action = 'write'"), newest)


@query(f"WITH {SPICED}, l AS (SELECT session, role, max(line) AS line, arg_max(content, line) AS content FROM u GROUP BY ALL) SELECT session, role, line, content FROM l")
def brief_latest(spark, d):
    return T.latest_by_role(D.spiced_turns(spark, d))


@query(f"WITH {SPICED}, l AS (SELECT session, role, max(line) AS line, arg_max(low, line) AS low FROM u GROUP BY ALL) SELECT session, line, 'blocked' AS marker FROM l WHERE regexp_matches(low, '\\b(?:blocked|blocker)\\b') UNION ALL SELECT session, line, 'failed' FROM l WHERE regexp_matches(low, '\\b(?:failed|failure)\\b')")
def open_markers(spark, d):
    return T.open_markers(D.spiced_turns(spark, d))


MARKS = """m AS (SELECT conv_id AS session, max(turn + 1) AS last, max(CASE WHEN role = 'user' THEN turn + 1 END) AS lu, max(CASE WHEN role = 'assistant' THEN turn + 1 END) AS la,
  CASE WHEN conv_id % 3 = 0 THEN max(turn + 1) END AS completed, CASE WHEN conv_id % 5 = 0 THEN 1 END AS interrupted, CASE WHEN conv_id % 7 = 0 THEN 2 END AS exit_failed,
  CASE conv_id % 4 WHEN 1 THEN 'active' WHEN 2 THEN 'blocked' WHEN 3 THEN 'completed' END AS checkpoint FROM conversations GROUP BY conv_id),
c AS (SELECT session, list_filter([CASE checkpoint WHEN 'active' THEN 'checkpoint_active' WHEN 'blocked' THEN 'checkpoint_blocked' END,
  CASE WHEN completed >= coalesce(interrupted, 0) THEN 'explicit_turn_completed' WHEN interrupted IS NOT NULL THEN 'interrupted_or_cancelled' END,
  CASE WHEN lu IS NOT NULL AND coalesce(la, 0) < lu THEN 'trailing_user_request_unanswered' END, CASE WHEN exit_failed > coalesce(completed, 0) THEN 'unresolved_tool_failure' END], lambda x: x IS NOT NULL) AS r FROM m)"""
STRONG = listed(S.STRONG)


def _evidence(spark, d):
    t = D.turns(spark, d)
    last = t.groupBy("session").agg(F.max("line").alias("last"))
    one = lambda k, line, kind: last.where(F.col("session") % k == 0).select("session", line.cast("long").alias("line"), F.lit(kind).alias("kind"))
    marks = one(3, F.col("last"), "completed").union(one(5, F.lit(1), "interrupted")).union(one(7, F.lit(2), "exit_failed"))
    k = F.col("session") % 4
    return S.evidence(t, marks).withColumn("checkpoint", F.when(k == 1, "active").when(k == 2, "blocked").when(k == 3, "completed"))


@query(f"WITH {MARKS} SELECT session, CASE WHEN len(r) = 0 THEN 'recent_activity_uncheckpointed' ELSE array_to_string(r, ',') END AS reasons, CASE WHEN len(list_intersect(r, {STRONG})) > 0 THEN 'high' WHEN list_contains(r, 'trailing_user_request_unanswered') THEN 'medium' ELSE 'low' END AS confidence FROM c")
def unfinished_reasons(spark, d):
    """Why a session counts as open, and how sure that is."""
    return S.reasons(_evidence(spark, d)).select("session", F.array_join("reasons", ",").alias("reasons"), "confidence")


@query(f"WITH {MARKS}, s AS (SELECT session, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (session % 700), '%Y-%m-%dT%H:%M:%SZ') AS modified FROM m) SELECT s.session, modified, len(r) AS n_reasons FROM s JOIN c USING (session) JOIN m USING (session) WHERE modified >= '2024-01-02T00:00:00Z' AND coalesce(checkpoint, '') <> 'completed'")
def unfinished_sessions(spark, d):
    """Recent sessions that no terminal checkpoint closed."""
    found = _evidence(spark, d)
    when = F.date_format(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, session % 700)"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    candidates = found.select("session", when.alias("modified"))
    rows = S.unfinished(candidates, S.reasons(found), found.where("checkpoint = 'completed'"), F.lit("2024-01-02T00:00:00Z"))
    return rows.select("session", "modified", F.when(F.col("reasons") == F.array(F.lit("recent_activity_uncheckpointed")), 0).otherwise(F.size("reasons")).cast("long").alias("n_reasons"))


@query("SELECT user_id AS session, max(event_id) AS seq, arg_max(event_type, event_id) AS status, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_checkpoint(spark, d):
    log = D.table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), "value")
    return S.latest_checkpoints(log)


@query("SELECT source, id, modified, path FROM (SELECT event_type AS source, user_id AS id, strftime(ts, '%Y-%m-%d') AS modified, props || event_id AS path, row_number() OVER (PARTITION BY event_type, user_id ORDER BY strftime(ts, '%Y-%m-%d') DESC, props || event_id) AS n FROM events) WHERE n = 1")
def candidate_dedup(spark, d):
    e = D.table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("modified"), F.concat("props", F.col("event_id").cast("string")).alias("path"))
    return S.dedup_candidates(e)


RETENTION = """r AS (SELECT user_id AS session, 'src' || user_id % 3 AS source, max(strftime(ts, '%Y-%m-%d')) AS modified, count(*) AS bytes FROM events GROUP BY user_id),
b AS (SELECT session, source, bytes, list_filter([CASE WHEN modified >= '2024-01-30' THEN 'inside_hot_window' END, CASE WHEN session % 2 = 0 THEN 'not_closed' END, CASE WHEN session % 5 = 0 THEN 'not_attested' END, CASE WHEN session % 7 = 0 THEN 'has_live_children' END], lambda x: x IS NOT NULL) AS blockers FROM r)"""


def _retention(spark, d):
    s = D.table(spark, d, "events").groupBy(F.col("user_id").alias("session")).agg(F.max(F.date_format("ts", "yyyy-MM-dd")).alias("modified"), F.count("*").alias("bytes")).withColumn("source", F.concat(F.lit("src"), F.col("session") % 3))
    return S.retention(s, F.lit("2024-01-30"), s.where("session % 2 <> 0"), s.where("session % 5 <> 0"), s.where("session % 7 = 0"))


@query(f"WITH {RETENTION} SELECT session, source, bytes, array_to_string(blockers, ',') AS blockers, len(blockers) = 0 AS eligible FROM b")
def retention_assessment(spark, d):
    return _retention(spark, d).withColumn("blockers", F.array_join("blockers", ","))


@query(f"WITH {RETENTION}, x AS (SELECT source, bytes, len(blockers) = 0 AS eligible, unnest(list_prepend(NULL, blockers)) AS blocker FROM b) SELECT source, blocker, count(*) AS sessions, sum(bytes) AS bytes, count_if(eligible) AS eligible FROM x GROUP BY GROUPING SETS ((source, blocker), (blocker))")
def retention_summary(spark, d):
    return S.retention_summary(_retention(spark, d))


@query("WITH RECURSIVE w AS (SELECT p_partkey AS session, p_partkey AS k, 0 AS depth FROM part UNION ALL SELECT session, k // 4, depth + 1 FROM w WHERE k > 0) SELECT 'part:' || session AS session, max(depth) AS depth FROM w GROUP BY session")
def sweep_depths(spark, d):
    """Children before parents: how deep each session is."""
    name = lambda c: F.concat(F.lit("part:"), c.cast("string"))
    key = F.col("p_partkey")
    return S.depths(D.table(spark, d, "part").select(name(key).alias("session"), F.when(key > 0, name(F.expr("p_partkey div 4"))).alias("parent")))


DECIDE = f"""
w AS (SELECT *, max(CASE WHEN role = 'user' AND {anyof('low', V.CONFIRMS)} THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY line ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) = 1 AS confirmed,
  last_value(CASE WHEN {anyof('low', V.RATIONALES)} THEN {cut('content', 500)} END IGNORE NULLS) OVER (PARTITION BY session ORDER BY line ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rationale,
  last_value(CASE WHEN role = 'user' THEN {cut('content', 200)} END IGNORE NULLS) OVER (PARTITION BY session ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS "trigger",
  len(list_filter(list(CASE WHEN {anyof('low', V.ALTERNATIVES)} THEN 1 END) OVER (PARTITION BY session ORDER BY line ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), lambda x: x IS NOT NULL)) AS n_alternatives,
  {firstof('low', [m for m, _ in V.DECISIONS])} AS marker FROM u),
dc AS (SELECT session, line, (MAP {{{", ".join(f"{quoted(m)}: {quoted(c)}" for m, c in V.DECISIONS)}}})[marker] AS category, confirmed, CASE WHEN confirmed THEN 0.9 ELSE 0.7 END AS confidence, rationale, "trigger", n_alternatives,
  {cut("trim(list_filter(regexp_split_to_array(content, '[.。!！?？]'), lambda s: contains(lower(s), marker))[1])", 300)} AS summary
  FROM w WHERE role = 'assistant' AND marker IS NOT NULL AND {anyof('low', V.DECIDES)} AND NOT {anyof('low', V.ASKS)})"""


@query(f"WITH {SPICED}, {DECIDE} SELECT * FROM dc")
def decisions(spark, d):
    """Decisions with who confirmed them, why, and what else was on the table."""
    return X.decisions(D.spiced_turns(spark, d)).withColumn("n_alternatives", F.size("alternatives").cast("long")).drop("alternatives")


BLOCKED = f"""
bw AS (SELECT *, max(CASE WHEN {anyof('low', V.RESOLVES)} THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY line ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) = 1 AS resolved, {firstof('low', [m for m, _ in V.BLOCKERS])} AS marker FROM u),
bc AS (SELECT session, line, (MAP {{{", ".join(f"{quoted(m)}: {quoted(c)}" for m, c in V.BLOCKERS)}}})[marker] AS category, resolved, {cut('content', 300)} AS description, {anyof('low', V.URGENT)} AS urgent FROM bw WHERE marker IS NOT NULL AND {anyof('low', V.BLOCKS)})"""


@query(f"WITH {SPICED}, {BLOCKED} SELECT session, line, category, description, resolved, round(least(1.0, (MAP {{{', '.join(f'{quoted(k)}: {v}' for k, v in V.SEVERITY.items())}}})[category] + CASE WHEN urgent THEN 0.2 ELSE 0.0 END), 6)::double AS severity FROM bc")
def blockers(spark, d):
    return X.blockers(D.spiced_turns(spark, d)).withColumn("severity", F.round("severity", 6))


@query(f"WITH {SPICED}, r AS (SELECT session, line, unnest(list_filter({listed(s for s, _, _ in V.REQUIREMENTS)}, lambda m: contains(low, m))) AS signal, {cut('content', 500)} AS requirement FROM u WHERE role = 'user') SELECT session, line, signal, (MAP {{{', '.join(f'{quoted(s)}: {quoted(c)}' for s, c, _ in V.REQUIREMENTS)}}})[signal] AS category, (MAP {{{', '.join(f'{quoted(s)}: {str(h).lower()}' for s, _, h in V.REQUIREMENTS)}}})[signal] AS hard, requirement FROM r")
def requirements(spark, d):
    return X.requirements(D.spiced_turns(spark, d))


@query(f"WITH {SPICED}, r AS (SELECT session, line, unnest(list_filter({listed(s for s, _ in V.DELIVERABLES)}, lambda m: contains(low, m))) AS marker, {cut('content', 500)} AS description, {anyof('low', ('confirm', '確認'))} AS confirmed FROM u WHERE role = 'user') SELECT session, line, marker, (MAP {{{', '.join(f'{quoted(s)}: {quoted(c)}' for s, c in V.DELIVERABLES)}}})[marker] AS kind, description, confirmed FROM r")
def deliverables(spark, d):
    return X.deliverables(D.spiced_turns(spark, d))


@query(f"WITH {SPICED}, b AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY line DESC) AS back, {firstof('low', [h[0] for h in V.HANDOFFS])} AS marker FROM u) SELECT session, line, (MAP {{{', '.join(f'{quoted(h[0])}: {quoted(h[1])}' for h in V.HANDOFFS)}}})[marker] AS type, (MAP {{{', '.join(f'{quoted(h[0])}: {h[2]}' for h in V.HANDOFFS)}}})[marker]::double AS priority, (MAP {{{', '.join(f'{quoted(h[0])}: {str(h[3]).lower()}' for h in V.HANDOFFS)}}})[marker] AS explicit, "
       + cut("trim(list_filter(regexp_split_to_array(content, '[.。!！?？]'), lambda s: contains(lower(s), marker))[1])", 300) + f" AS instruction FROM b WHERE back <= 80 AND role = 'user' AND marker IS NOT NULL AND {anyof('low', V.HANDS_OFF)}")
def handoffs(spark, d):
    return X.handoffs(D.spiced_turns(spark, d))


_SLOTS = " UNION ALL ".join(f"SELECT session, '{slot}' AS slot, {size} AS size, min(n) AS at_n, min(line) AS line FROM nn WHERE {anyof('low', m)}{f' AND role = {quoted(role)}' if role else ''} GROUP BY session" for slot, (role, size, m) in V.NARRATIVE.items())


@query(f"WITH {SPICED}, nn AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY line) AS n FROM u), o AS ({_SLOTS}), s AS (SELECT o.session, slot, o.line, string_agg(nn.content || chr(10), '' ORDER BY nn.n) AS x FROM o JOIN nn ON nn.session = o.session AND nn.n >= at_n AND nn.n < at_n + size AND nn.role <> 'system' AND nn.content <> '' GROUP BY ALL) SELECT session, slot, line, {cut('x', 1000)} AS section FROM s")
def narrative(spark, d):
    """The first turn that opens each slot of the story, and what is said from there."""
    return X.narrative(D.spiced_turns(spark, d))


@query(f"WITH {SPICED}, l AS (SELECT session, max(line) AS line, arg_max(content, line) AS content FROM u WHERE role = 'user' GROUP BY session) SELECT session, line, {cut('content', 500)} AS intent FROM l")
def last_intent(spark, d):
    return X.last_intent(D.spiced_turns(spark, d))


@query(f"WITH {SPICED}, l AS (SELECT session, max(line) AS line, arg_max(content, line) AS content FROM u WHERE role = 'user' GROUP BY session) SELECT session, 'knowledge:intent:' || session || ':' || substr(sha256({cut('content', 500)}), 1, 16) AS id FROM l")
def knowledge_ids(spark, d):
    return X.last_intent(D.spiced_turns(spark, d)).select("session", X.knowledge_id("intent", F.col("session").cast("string"), F.col("intent")).alias("id"))


@query(f"""WITH {SPICED}, {DECIDE}, {BLOCKED}, s AS (SELECT DISTINCT session FROM u), h AS (SELECT session, count(*) AS n FROM u WHERE role = 'user' AND ({' OR '.join(f"contains(low, {quoted(s)})" for s, _, hard in V.REQUIREMENTS if hard)}) GROUP BY session)
SELECT s.session, round(least(1.0, least((SELECT count(*) FROM bc WHERE bc.session = s.session AND NOT resolved) * 0.15, 0.5) + least((SELECT count(*) FROM dc WHERE dc.session = s.session AND NOT confirmed) * 0.05, 0.2) + least(coalesce(h.n, 0) * 0.05, 0.1) + 0.1 + 0.1), 6)::double AS score FROM s LEFT JOIN h USING (session)""")
def unfinished_score(spark, d):
    """How much of a session is open, from its blockers, decisions and hard requirements."""
    u = D.spiced_turns(spark, d)
    count = lambda df, name: df.groupBy("session").agg(F.count("*").alias(name))
    hard = X.requirements(u).where("hard").select("session", "line").distinct()
    rows = u.select("session").distinct()
    for part in (count(X.blockers(u).where("not resolved"), "open_blockers"), count(X.decisions(u).where("not confirmed"), "unconfirmed"), count(hard, "hard")):
        rows = rows.join(part, "session", "left")
    rows = rows.na.fill(0).selectExpr("*", "0 AS open_changes", "0 AS urgent_handoffs", "false AS has_state", "false AS has_next", "0 AS state_blockers", "false AS has_verification", "cast(null as int) AS story_slots")
    return X.unfinished_score(rows).select("session", F.round("score", 6).alias("score"))
