"""Status, timeline, briefs, pages and health of a knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import VERSION, event_id
from ..functions.text import is_terminal
from . import graph as G


def status(journal: DataFrame) -> DataFrame:
    """One row: events, nodes, edge rows and artifact nodes."""
    g = G.materialize(journal, include_expired=True)
    kinds = g.columns("type").agg(F.count("*").alias("nodes"), F.count_if(F.lower("type") == "artifact").alias("artifacts"))
    return journal.agg(F.count("*").alias("events")).crossJoin(kinds).crossJoin(g.edges.agg(F.count("*").alias("edges")))  # three rows of counts


def timeline(journal: DataFrame, prefix: str = "") -> DataFrame:
    """Events whose time begins with a year or month, in order, each with a line about it."""
    field = lambda k: F.get_json_object("payload", f"$.{k}")
    summary = (
        F.when(F.col("op") == "node.upsert", F.concat_ws(" ", field("id"), F.coalesce(field("label"), F.lit(""))))
        .when(F.col("op").isin("edge.assert", "edge.retract"), F.concat_ws(" ", field("from"), field("type"), field("to"))).otherwise(field("key"))
    )
    return journal.where(F.col("observed_utc").startswith(prefix)).select("seq", "observed_utc", "op", F.trim(summary).alias("summary"))


def task_brief(graph: G.Graph, everything: bool = False) -> DataFrame:
    """(id, projects, status, label, updated): tasks with their projects; ended ones only if everything is asked for."""
    nodes = graph.columns("type", "status", "label")
    projects = nodes.where("lower(type) = 'project'").select(F.col("id").alias("to"))
    member = graph.edges.where("not retracted and edge = 'BELONGS_TO'").join(projects, "to", "left_semi").groupBy(F.col("from").alias("id")).agg(F.array_sort(F.collect_set("to")).alias("projects"))
    tasks = nodes.where("lower(type) = 'task'").join(member, "id", "left")
    tasks = tasks if everything else tasks.where(~is_terminal(F.col("status")))
    blank = lambda c, other: F.when(F.coalesce(F.col(c), F.lit("")) == "", other).otherwise(F.col(c))
    return tasks.select("id", F.coalesce("projects", F.expr("cast(array() as array<string>)")).alias("projects"), blank("status", F.lit("unknown")).alias("status"), blank("label", F.col("id")).alias("label"), F.col("observed_utc").alias("updated"))


#: Sections of a project's page, in order: header, id prefixes, node kinds. The prefix decides before the kind.
SECTIONS = (
    ("Tasks", ("task", "order"), ("task",)), ("Decisions", ("decision",), ("decision",)), ("Documents", ("document",), ("document",)), ("Experiments", ("experiment",), ("experiment",)),
    ("Datasets", ("dataset",), ("dataset",)), ("Models", ("model",), ("model",)), ("Artifacts", ("artifact", "part"), ("artifact",)), ("Conversations", ("conversation",), ("conversation",)),
    ("Products", ("product", "supplier"), ("product",)), ("Sources", ("source",), ("source",)), ("Organizations", ("organization",), ("organization",)),
)


def section_of(node: Column, kind: Column) -> Column:
    """The place of a member's section, null if it has none."""
    by_prefix, by_kind = F.lit(None).cast("int"), F.lit(None).cast("int")
    for n, (_, prefixes, kinds) in reversed(list(enumerate(SECTIONS))):
        by_prefix = F.when(F.substring_index(node, ":", 1).isin(*prefixes) & node.contains(":"), n).otherwise(by_prefix)
        by_kind = F.when(F.lower(kind).isin(*kinds), n).otherwise(by_kind)
    return F.coalesce(by_prefix, by_kind)


def project_pages(graph: G.Graph) -> DataFrame:
    """(project, section, members): who is tied to a project, in either direction, undated first, then by date and label."""
    nodes = graph.columns("type", "label", "date")
    projects = nodes.where("lower(type) = 'project'").select(F.col("id").alias("project"))
    live = graph.edges.where("not retracted").select("from", "to").distinct()
    ends = live.select(F.col("to").alias("project"), F.col("from").alias("id")).union(live.select("from", "to")).distinct().join(projects, "project", "left_semi")
    members = ends.join(nodes, "id").withColumn("place", section_of(F.col("id"), F.col("type"))).where("place is not null")
    names = F.array(*[F.lit(s[0]) for s in SECTIONS])
    key = F.struct(F.coalesce("date", F.lit("")).alias("date"), F.coalesce("label", "id").alias("label"), "id")
    return members.groupBy("project", "place").agg(F.array_sort(F.collect_list(key)).alias("m")).select("project", names[F.col("place")].alias("section"), F.col("m.label").alias("members"))


def doctor(journal: DataFrame, quarantine: DataFrame, consumed: DataFrame | None = None, inbox: DataFrame | None = None, version: str = VERSION) -> DataFrame:
    """(check, severity, problems, detail): five checks; 0 is fine, 1 a warning, 2 an error, and the largest is the exit code."""
    bad = quarantine.agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    valid = bad.select(F.lit("journal-valid").alias("check"), F.when(F.col("n") > 0, 2).otherwise(0).alias("severity"), F.col("n").alias("problems"), F.concat(F.lit("first at "), F.col("first").cast("string")).alias("detail"))
    listed = bad.select(F.lit("quarantine-list"), F.when(F.col("n") > 0, 1).otherwise(0), "n", F.lit(None).cast("string"))
    wrong = journal.where(F.col("id") != event_id(F.col("op"), F.col("payload"), version)).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    index = wrong.select(F.lit("index-rebuildable"), F.when(F.col("n") > 0, 2).otherwise(0), "n", F.concat(F.lit("first at "), F.col("first").cast("string")))
    g = G.materialize(journal, include_expired=True)
    loose = G.dangling(g.edges, g.nodes).agg(F.count("*").alias("n"), F.min(F.concat_ws(" ", "from", "edge", "to")).alias("first"))
    refs = loose.select(F.lit("ref-integrity"), F.when(F.col("n") > 0, 1).otherwise(0), "n", "first")
    out = valid.union(listed).union(index).union(refs)
    if consumed is not None and inbox is not None:
        gone = consumed.join(inbox, "name", "left_anti").agg(F.count("*").alias("n"), F.min("name").alias("first"))
        out = out.union(gone.select(F.lit("tap-cursor"), F.when(F.col("n") > 0, 1).otherwise(0), "n", "first"))
    return out


def ledger_state(receipts: DataFrame, events: DataFrame) -> DataFrame:
    """Receipts (id, path, class, sha256) with what later events (receipt, sequence, path, class) moved or reclassified, and whether one superseded them (supersedes)."""
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("sequence"))).alias(f"new_{c}")
    moved = events.groupBy(F.col("receipt").alias("id")).agg(last("path"), last("class"))
    gone = receipts.where("supersedes is not null").select(F.col("supersedes").alias("id")).distinct().withColumn("superseded", F.lit(True))
    return receipts.join(moved, "id", "left").join(gone, "id", "left").select("id", F.coalesce("new_path", "path").alias("path"), F.coalesce("new_class", "class").alias("class"), "sha256", F.coalesce("superseded", F.lit(False)).alias("superseded"))


def ledger_check(state: DataFrame, files: DataFrame) -> DataFrame:
    """(id, finding) of effective receipts against the files (path, sha256) that are there: active, missing, changed or superseded."""
    j = state.join(files.select("path", F.col("sha256").alias("now")), "path", "left")
    return j.select("id", F.when(F.col("superseded"), "superseded").when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "changed").otherwise("active").alias("finding"))


def by_day(journal: DataFrame) -> DataFrame:
    """(day, op, n, running): events a day and operation and so far."""
    daily = journal.groupBy(F.substring("observed_utc", 1, 10).alias("day"), "op").agg(F.count("*").alias("n"))
    return daily.withColumn("running", F.sum("n").over(Window.partitionBy("op").orderBy("day")))
