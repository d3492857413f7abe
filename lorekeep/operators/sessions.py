"""Which sessions are unfinished, why, and what may be cleaned up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRONG = ("checkpoint_active", "checkpoint_blocked", "task_state_outstanding", "interrupted_or_cancelled", "unresolved_tool_failure")


def dedup_candidates(candidates: DataFrame) -> DataFrame:
    """One row a (source, id): the latest modified, then the smallest path."""
    w = Window.partitionBy("source", "id").orderBy(F.desc("modified"), "path")
    return candidates.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def latest_checkpoints(log: DataFrame) -> DataFrame:
    """Each session's last checkpoint in the order of the log (seq)."""
    fields = [c for c in log.columns if c != "session"]
    return log.groupBy("session").agg(F.max_by(F.struct(*fields), "seq").alias("c")).select("session", "c.*")


def evidence(turns: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """One row a session: last lines of each side and, from outcomes (session, line, kind), of terminal marks.

    kind is one of started, completed, interrupted, exit_failed, exit_ok, tool_failed, tool_ok.
    """
    said = turns.groupBy("session").agg(
        F.max(F.when(F.col("role") == "user", F.col("line"))).alias("last_user"), F.max(F.when(F.col("role") == "assistant", F.col("line"))).alias("last_assistant"), F.max("line").alias("last_line")
    )
    kinds = ("started", "completed", "interrupted", "exit_failed", "exit_ok", "tool_failed", "tool_ok")
    if outcomes is None:
        return said.select("*", *(F.lit(None).cast("long").alias(k) for k in kinds))
    marks = outcomes.groupBy("session").agg(*(F.max(F.when(F.col("kind") == k, F.col("line"))).alias(k) for k in kinds))
    return said.join(marks, "session", "left")


def reasons(found: DataFrame) -> DataFrame:
    """(session, reasons, confidence) from evidence and, if present, the columns checkpoint and outstanding.

    The newest terminal mark tells the state: a completion closes what went before it; a turn that began and didn't
    end is open. A failed command stays open until a later success or completion, a failed tool until a later success.
    """
    c = lambda k: F.col(k)
    later = lambda a, b: c(a).isNotNull() & (c(b).isNull() | (c(a) > c(b)))
    in_flight = F.when(later("started", "completed"), c("started"))
    negative = F.greatest(c("interrupted"), in_flight)
    done = c("completed").isNotNull() & (negative.isNull() | (c("completed") >= negative))
    codes = [
        F.when(done, "explicit_turn_completed").when(negative.isNotNull(), "interrupted_or_cancelled"),
        F.when(c("last_user").isNotNull() & (c("last_assistant").isNull() | (c("last_assistant") < c("last_user"))), "trailing_user_request_unanswered"),
        F.when((later("exit_failed", "exit_ok") & later("exit_failed", "completed")) | later("tool_failed", "tool_ok"), "unresolved_tool_failure"),
    ]
    if "outstanding" in found.columns:
        codes.insert(0, F.when(c("outstanding") > 0, "task_state_outstanding"))
    if "checkpoint" in found.columns:
        codes.insert(0, F.when(c("checkpoint") == "active", "checkpoint_active").when(c("checkpoint") == "blocked", "checkpoint_blocked"))
    listed = F.array_compact(F.array(*codes))
    rows = found.select("session", F.when(F.size(listed) == 0, F.array(F.lit("recent_activity_uncheckpointed"))).otherwise(listed).alias("reasons"))
    return rows.withColumn("confidence", confidence(F.col("reasons")))


def confidence(codes: Column) -> Column:
    """high with explicit evidence of open work, medium with an unanswered request, low otherwise."""
    strong = F.arrays_overlap(codes, F.array(*map(F.lit, STRONG)))
    return F.when(strong, "high").when(F.array_contains(codes, "trailing_user_request_unanswered"), "medium").otherwise("low")


def unfinished(candidates: DataFrame, reasoned: DataFrame, closed: DataFrame, since: Column) -> DataFrame:
    """Candidates (session, modified) since a time that no terminal checkpoint closed, with their reasons, newest first."""
    open_ = candidates.where(F.col("modified") >= since).join(closed.select("session"), "session", "left_anti")
    return open_.join(reasoned, "session").orderBy(F.desc("modified"), "session")


def next_action(checkpoint: Column, item: Column) -> Column:
    """What to do next and what says so."""
    said = lambda text, basis: F.struct(text.alias("action"), F.lit(basis).alias("basis"))
    fine = lambda x: F.coalesce(F.trim(x) != "", F.lit(False))
    return F.when(fine(checkpoint), said(checkpoint, "checkpoint")).when(fine(item), said(item, "task_state")).otherwise(said(F.lit("Review the session and record the next action"), "placeholder"))


def retention(sessions: DataFrame, cutoff: Column, closed: DataFrame, attested: DataFrame, live_parents: DataFrame) -> DataFrame:
    """Sessions (session, source, modified, bytes) with the codes of what forbids to clean them up; none: eligible."""
    mark = lambda df, name: df.select("session").distinct().withColumn(name, F.lit(True))
    j = sessions.join(mark(closed, "c"), "session", "left").join(mark(attested, "a"), "session", "left").join(mark(live_parents, "p"), "session", "left")
    blockers = F.array_compact(F.array(
        F.when(F.col("modified") >= cutoff, "inside_hot_window"), F.when(F.col("c").isNull(), "not_closed"),
        F.when(F.col("a").isNull(), "not_attested"), F.when(F.col("p").isNotNull(), "has_live_children"),
    ))
    return j.select("session", "source", "bytes", blockers.alias("blockers"), (F.size(blockers) == 0).alias("eligible"))


def retention_summary(assessed: DataFrame) -> DataFrame:
    """(source, blocker, sessions, bytes, eligible): counts by source and in total (source null), and by blocker (else null)."""
    each = assessed.select("source", "bytes", "eligible", F.explode(F.concat(F.array(F.lit(None).cast("string")), "blockers")).alias("blocker"))
    return each.rollup("blocker", "source").agg(F.grouping_id().alias("g"), F.count("*").alias("sessions"), F.sum("bytes").alias("bytes"), F.count_if("eligible").alias("eligible")).where("g < 2").select("source", "blocker", "sessions", "bytes", "eligible")


def depths(sessions: DataFrame, most: int = 64) -> DataFrame:
    """(session, depth): steps to the root along parent; children are swept before their parents (depth falling)."""
    from .graph import closure

    links = sessions.where("parent is not null").select(F.col("session").alias("from"), F.col("parent").alias("to"))
    return closure(sessions.select(F.col("session").alias("id")), links, most).groupBy(F.col("root").alias("session")).agg(F.max("depth").alias("depth"))


def runtime_reasons(statuses: DataFrame) -> DataFrame:
    """(session, code, detail): what a runtime's own status (session, status, error) says of open work; only aborted and error say anything."""
    said = F.when(F.coalesce(F.col("error"), F.lit("")) != "", F.concat(F.lit("runtime status error: "), "error")).otherwise("runtime marks the conversation errored")
    code = F.when(F.col("status") == "aborted", "interrupted_or_cancelled").when(F.col("status") == "error", "unresolved_tool_failure")
    detail = F.when(F.col("status") == "aborted", "runtime marks the conversation aborted").otherwise(said)
    return statuses.select("session", code.alias("code"), detail.alias("detail")).where("code is not null")
