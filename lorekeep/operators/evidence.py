"""Readiness, eligibility, dependency closure and decision history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_calendar_stamp
from . import graph as G
from .lineage import settle

#: Decisions of equal origins that one block of pairs takes, about.
PAIR_BLOCK = 500
#: Pairs to compare in one task, about.
PAIRS_A_TASK = 4_000_000


def readiness(premises: DataFrame, by: str = "case") -> DataFrame:
    """(by, readiness): refuted beats missing beats supported; a case without premises isn't listed, see assess_all.

    premises: by, premise, supports, refutes (counts), missing (whether the fact is absent).
    """
    flags = premises.groupBy(by).agg(F.bool_or(F.col("refutes") > 0).alias("refuted"), F.bool_or("missing").alias("missing"))
    return flags.select(by, F.when(F.col("refuted"), "conflicting_evidence").when(F.col("missing"), "needs_more_evidence").otherwise("supported_investigation").alias("readiness"))


def premise_error(premise: Column, supports: Column, refutes: Column, missing: Column) -> Column:
    """Why a premise can't be judged, null if it can. supports and refutes are arrays of source ids, missing names an absent fact."""
    none = (F.size(supports) == 0) & (F.size(refutes) == 0)
    return (
        F.when(F.trim(F.coalesce(premise, F.lit(""))) == "", "premise identity missing")
        .when(F.arrays_overlap(supports, refutes), "a source both supports and refutes")
        .when(F.trim(missing) == "", "missing fact must identify the absent fact")
        .when(missing.isNotNull() & ~none, "a premise cannot be both missing and evidenced")
        .when(missing.isNull() & none, "missing premise must identify the absent fact")
    )


def eligibility(nodes: DataFrame, scope: DataFrame, pins: DataFrame, earliest: str, as_of: str) -> DataFrame:
    """(id, problem) for each node in scope: the first reason that forbids to cite it, null without any.

    nodes: id, hash, observed_utc, provenance; scope: id; pins: id, hash.
    """
    j = scope.select("id").distinct().join(pins.select("id", F.lower("hash").alias("pin")), "id", "left").join(nodes.select("id", F.col("hash").alias("now"), "observed_utc", "provenance"), "id", "left")
    at = F.col("observed_utc")
    problem = (
        F.when(F.col("pin").isNull(), "source_pin_missing").when(F.col("now").isNull(), "scope_or_source_unavailable").when(F.col("now") != F.col("pin"), "source_changed")
        .when(~is_calendar_stamp(at), "observation_time_unknown").when((at < earliest) | (at > as_of), "observation_outside_window")
        .when(F.trim(F.coalesce("provenance", F.lit(""))) == "", "source_provenance_missing")
    )
    return j.select("id", problem.alias("problem"))


def evidence_closure(roots: DataFrame, edges: DataFrame, eligible: DataFrame, hops: int) -> DataFrame:
    """(root, members, problem): what each root depends on, and the first kind of problem found in it.

    Dependencies are followed for hops steps; one more is a hop_limit. An ineligible member's problem, or a live
    contradiction of a member (unresolved_conflict), spoils the root.
    """
    live = edges.where("not retracted")
    needs = live.where("edge = 'DEPENDS_ON'").select("from", "to").distinct()
    reach = G.closure(roots, needs, hops + 1)
    fought = live.where("edge = 'CONTRADICTS'")
    fought = fought.select(F.col("from").alias("id")).union(fought.select("to")).distinct().withColumn("conflict", F.lit(True))
    known = eligible.withColumn("listed", F.lit(True))
    j = reach.join(known, "id", "left").join(fought, "id", "left")
    rank = (
        F.when(F.col("listed").isNull(), F.struct(F.lit(0).alias("n"), F.lit("scope_or_source_unavailable").alias("why")))
        .when(F.col("problem").isNotNull(), F.struct(F.lit(1).alias("n"), F.col("problem").alias("why")))
        .when(F.col("conflict"), F.struct(F.lit(2).alias("n"), F.lit("unresolved_conflict").alias("why")))
        .when(F.col("depth") > hops, F.struct(F.lit(3).alias("n"), F.lit("hop_limit").alias("why")))
    )
    members = F.array_sort(F.collect_set(F.when(F.col("depth") <= hops, F.col("id"))))
    return j.groupBy("root").agg(members.alias("members"), F.min(rank).alias("p")).select("root", "members", F.col("p.why").alias("problem"))


def current_decisions(history: DataFrame) -> DataFrame:
    """Decisions (task, id, place, supersedes, depends_on) that no later one of their task supersedes."""
    gone = history.select("task", F.explode("supersedes").alias("id")).distinct()
    return history.join(gone, ["task", "id"], "left_anti")


def history_errors(history: DataFrame) -> DataFrame:
    """(task, id, error): decisions out of order in time, or that refer forward, to themselves or to another task."""
    w = Window.partitionBy("task").orderBy("place")
    late = history.withColumn("before", F.lag("observed_at").over(w)).where(F.col("observed_at") < F.col("before")).select("task", "id", F.lit("not chronological").alias("error"))
    refs = history.select("task", "id", "place", F.explode(F.concat("supersedes", "depends_on")).alias("ref"))
    known = history.select(F.col("task").alias("t2"), F.col("id").alias("ref"), F.col("place").alias("at"))
    j = refs.join(known, "ref", "left")
    bad = j.groupBy("task", "id", "ref").agg(F.max(F.coalesce((F.col("t2") == F.col("task")) & (F.col("at") < F.col("place")), F.lit(False))).alias("fine")).where("not fine")
    return late.union(bad.select("task", "id", F.concat(F.lit("unknown or later reference: "), "ref")))


def applicability(decisions: DataFrame, conditions: DataFrame) -> DataFrame:
    """(task, id, missing, mismatched): decisions' conditions (map) that the task's map lacks or contradicts."""
    j = decisions.join(conditions.select("task", F.col("conditions").alias("now")), "task", "left")
    have = F.coalesce("now", F.expr("cast(map() as map<string,string>)"))
    missing = F.map_keys(F.map_filter("conditions", lambda k, v: ~F.map_contains_key(have, k)))
    wrong = F.map_keys(F.map_filter("conditions", lambda k, v: F.map_contains_key(have, k) & (F.try_element_at(have, k) != v)))
    return j.select("task", "id", F.array_sort(missing).alias("missing"), F.array_sort(wrong).alias("mismatched"))


def ancestors(history: DataFrame, field: str) -> DataFrame:
    """(id, ancestor): everything a decision supersedes or depends on (field), however far back."""
    links = history.select(F.col("id").alias("from"), F.explode(field).alias("to"))
    return G.reachable(links).select(F.col("from").alias("id"), F.col("to").alias("ancestor"))


def competing(history: DataFrame) -> DataFrame:
    """(task, a, b): current decisions of a task that supersede a common ancestor: branches nobody merged.

    Decisions have a common ancestor if their histories share an origin. Those of equal origins are one kind, so each
    pair is made once; the second of a pair is dealt by blocks of its kind, so that a large kind is many small joins.
    """
    now = current_decisions(history).select("task", "id").distinct()
    links = history.select(F.col("id").alias("from"), F.explode("supersedes").alias("to"))
    ends = G.origins(links).withColumnRenamed("from", "id")
    held = settle(now.join(ends, "id").groupBy("task", "id").agg(F.array_sort(F.collect_set("to")).alias("origins")))
    kinds = settle(held.groupBy("task", "origins").agg(F.min("id").alias("kind"), F.count("*").alias("n")))
    member = held.join(kinds, ["task", "origins"]).select("task", "id", "kind", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / PAIR_BLOCK)).alias("block"))
    by_end = kinds.select("task", "kind", "n", F.explode("origins").alias("end"))
    other = by_end.select("task", "end", F.col("kind").alias("other"), F.col("n").alias("m"))
    met = settle(by_end.join(other, ["task", "end"]).select("task", "kind", "other", "n", "m").distinct())
    pairs = met.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    parts = max(int(history.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS_A_TASK))  # a few rows make many, so sizes don't tell
    met = met.select("task", "kind", "other", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("m") / PAIR_BLOCK) - 1)).alias("block"))
    a = member.select("task", "kind", F.col("id").alias("a")).join(met, ["task", "kind"]).select("task", "a", "other", "block")
    b = member.select("task", F.col("id").alias("b"), F.col("kind").alias("other"), "block")
    a, b = (side.repartition(parts, "task", "other", "block") for side in (a, b))
    return a.join(b, ["task", "other", "block"]).where("a < b").select("task", "a", "b")


def citations(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """(quote_id, source_id, start, problem): where a quote stands in its source, from 1; a quote that isn't there or stands twice is a problem."""
    j = quotes.join(sources, "source_id", "left")
    at = F.expr("locate(quote, text)")
    again = F.expr("locate(quote, text, locate(quote, text) + 1)")
    problem = F.when(F.col("text").isNull(), "source_unknown").when(F.col("quote") == "", "quote_empty").when(at == 0, "quote_absent").when(again > 0, "quote_ambiguous")
    return j.select("quote_id", "source_id", F.when(problem.isNull(), at).alias("start"), problem.alias("problem"))


def edge_receipts(edges: DataFrame) -> DataFrame:
    """Edges with receipt: the JSON, keys in order and nulls kept, by which a citation names an edge."""
    fields = (("from", "from"), ("observed_utc", "observed_utc"), ("provenance", "provenance"), ("to", "to"), ("type", "edge"), ("valid_from", "valid_from"), ("valid_until", "valid_until"))
    return edges.withColumn("receipt", F.to_json(F.struct(*(F.col(c).alias(k) for k, c in fields)), {"ignoreNullFields": "false"}))
