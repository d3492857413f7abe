"""Writing: derived tables, stores and logs, and the events that record facts in the journal.

Event makers return (op, payload) rows for journal.prepare(); stores are Parquet folders that only grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import searchable_text
from ..operators import graph as G
from ..operators import lexical as L


def _event(rows: DataFrame, op: str, **fields: Column) -> DataFrame:
    payload = F.to_json(F.struct(*[v.alias(k.rstrip("_")) for k, v in fields.items()]))
    return rows.select(F.lit(op).alias("op"), payload.alias("payload"))


def upserts(rows: DataFrame, **fields: Column) -> DataFrame:
    return _event(rows, "node.upsert", **fields)


def asserts(rows: DataFrame, source: Column, kind: str, target: Column, **fields: Column) -> DataFrame:
    return _event(rows, "edge.assert", from_=source, type=F.lit(kind), to=target, **fields)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def build_indexes(journal: DataFrame, folder: str) -> None:
    """nodes, edges and postings of a journal as tables, written over what was there: building twice changes nothing."""
    g = G.materialize(journal, include_expired=True)
    g.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    g.edges.write.mode("overwrite").parquet(f"{folder}/edges")
    L.postings(g.nodes, "id", searchable_text(F.col("attrs"))).write.mode("overwrite").parquet(f"{folder}/postings")


def checked_edges(proposed: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(legal edges as events, rejects with their error) of proposed edges (from, type, to, provenance) against nodes (id, type, provenance)."""
    from ..functions.text import edge_kind, is_location, node_kind

    kinds = nodes.select("id", node_kind(F.col("type")).alias("kind"), F.col("provenance").alias("lent"))
    a = kinds.select(F.col("id").alias("from"), F.col("kind").alias("from_kind"), "lent")
    b = kinds.select(F.col("id").alias("to"), F.col("kind").alias("to_kind"))
    j = proposed.join(a, "from", "left").join(b, "to", "left").withColumn("edge", edge_kind(F.col("type")))
    absent = F.when(F.col("from_kind").isNull(), "dangling_from").when(F.col("to_kind").isNull() & ~is_location(F.col("to")), "dangling_to")
    error = F.coalesce(absent, G.triple_error(F.col("from_kind"), F.col("edge"), F.col("to_kind"), F.col("to"), F.coalesce("provenance", "lent")))
    judged = j.withColumn("error", error)
    good = _event(judged.where("error is null"), "edge.assert", from_=F.col("from"), type=F.col("edge"), to=F.col("to"), provenance=F.col("provenance"))
    return good, judged.where("error is not null").select("from", "type", "to", "error")


def add_artifacts(files: DataFrame, store: str) -> DataFrame:
    """Content (name, content) that the store doesn't hold yet goes in under its hash, in a batch of its own.

    Returns (name, sha256, bytes, batch): all files, and the batch that first held their content.
    """
    spark = files.sparkSession
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    batch = 0
    if _exists(spark, store):
        held = spark.read.parquet(store)
        batch = int(held.agg(F.max("batch")).first()[0]) + 1
        new = hashed.join(held.select("sha256"), "sha256", "left_anti")
    else:
        new = hashed
    new.dropDuplicates(["sha256"]).withColumn("batch", F.lit(batch)).select("sha256", "content", "batch").write.mode("append").parquet(store)
    return hashed.select("name", "sha256", F.octet_length("content").alias("bytes")).join(spark.read.parquet(store).select("sha256", "batch"), "sha256")


def next_sequence(log: DataFrame) -> int:
    """The number that the next entry of an append-only log gets."""
    return int(log.agg(F.coalesce(F.max("sequence"), F.lit(-1))).first()[0]) + 1


def append_log(entries: DataFrame, path: str) -> int:
    """Entries with place (0, 1, ...) go to the end of a log, numbered on; returns the first number."""
    spark = entries.sparkSession
    first = next_sequence(spark.read.parquet(path)) if _exists(spark, path) else 0
    entries.withColumn("sequence", (F.lit(first) + F.col("place")).cast("long")).drop("place").write.mode("append").parquet(path)
    return first


def ledger_timeline(receipts: DataFrame, events: DataFrame) -> DataFrame:
    """(date, kind, id, text): receipts (id, date, title) and events (id, date, kind, receipt, note) of a ledger in one line, in order."""
    r = receipts.select("date", F.lit("receipt").alias("kind"), "id", F.col("title").alias("text"))
    e = events.select("date", "kind", "id", F.concat_ws(" ", "receipt", "note").alias("text"))
    return r.union(e).orderBy("date", "kind", "id")


def mirror_receipts(receipts: DataFrame) -> DataFrame:
    """Receipts (id, document, project, title, path, sha256) as a revision and a document node with their edges."""
    revision, document = F.concat(F.lit("revision:"), "id"), F.concat(F.lit("document:"), "document")
    said = F.lit("ledger")
    return (
        upserts(receipts, id=revision, type=F.lit("Artifact"), label=F.col("title"), path=F.col("path"), content_sha256=F.col("sha256"), provenance=said)
        .union(upserts(receipts.dropDuplicates(["document"]), id=document, type=F.lit("Document"), label=F.col("document"), provenance=said))
        .union(asserts(receipts, revision, "REVISION_OF", document, provenance=said))
        .union(asserts(receipts, revision, "BELONGS_TO", F.col("project"), provenance=said))
        .union(asserts(receipts, document, "REFERENCES_PROJECT", F.col("project"), provenance=said))
    )


def history_changes(saved: DataFrame, proposed: DataFrame) -> DataFrame:
    """(id, problem): saved decisions (id, sha256) that a proposed history leaves out or writes anew; a history may only grow."""
    j = saved.select("id", F.col("sha256").alias("was")).join(proposed.select("id", F.col("sha256").alias("now")), "id", "left")
    return j.where("now is null or now <> was").select("id", F.when(F.col("now").isNull(), "removed").otherwise("rewritten").alias("problem"))


def constraint_events(constraints: DataFrame) -> DataFrame:
    """Constraints (project, text, source, label) as nodes that belong to their project; the id is the project and a hash of the words."""
    ident = F.concat_ws(":", F.lit("constraint"), F.regexp_replace("project", r"\A[^:]*:", ""), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 8))
    label = F.coalesce("label", F.substring("text", 1, 80))
    return upserts(constraints, id=ident, type=F.lit("Constraint"), label=label, body=F.col("text"), provenance=F.col("source")).union(asserts(constraints, ident, "BELONGS_TO", F.col("project"), provenance=F.col("source")))


def quoted_constraints(turns: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(constraints, rejects): wanted (session, line, project, quote) whose quote stands in that line as the user wrote it."""
    j = wanted.join(turns.where("role = 'user'").select("session", "line", "content"), ["session", "line"], "left")
    fine = F.coalesce(F.col("content").contains(F.col("quote")) & (F.trim("quote") != ""), F.lit(False))
    good = j.where(fine).select("project", F.col("quote").alias("text"), F.concat(F.lit("conversation:"), "session", F.lit("#"), "line").alias("source"), F.lit(None).cast("string").alias("label"))
    return good, j.where(~fine).select("session", "line", "project", "quote")


def knowledge_events(facts: DataFrame) -> DataFrame:
    """Extracted facts (id, session, kind, text, confidence) as nodes derived from their conversation, which is a node too."""
    talk = F.concat(F.lit("conversation:"), "session")
    sessions = facts.select("session").distinct()
    return (
        upserts(sessions, id=talk, type=F.lit("Conversation"), label=F.col("session").cast("string"), provenance=F.lit("extraction"))
        .union(upserts(facts, id=F.col("id"), type=F.concat(F.lit("Knowledge"), F.initcap("kind")), label=F.substring("text", 1, 80), body=F.col("text"), confidence=F.col("confidence"), provenance=talk))
        .union(asserts(facts, F.col("id"), "DERIVED_FROM", talk, provenance=talk))
    )


def wiki_events(pages: DataFrame) -> DataFrame:
    """Pages (id, name, title, sources) as wiki nodes, each source reference as a source node that the page derives from."""
    said = F.concat(F.lit("wiki:"), "name")
    refs = pages.select("id", "name", F.explode("sources").alias("ref"))
    source = F.concat(F.lit("source:"), F.substring(F.sha2(F.col("ref").cast("binary"), 256), 1, 16))
    return (
        upserts(pages, id=F.col("id"), type=F.lit("Wiki"), label=F.col("title"), path=F.col("name"), managed_by=F.lit("wiki"), provenance=said)
        .union(upserts(refs.dropDuplicates(["ref"]), id=source, type=F.lit("Source"), label=F.col("ref"), path=F.col("ref"), managed_by=F.lit("wiki"), provenance=said))
        .union(asserts(refs.dropDuplicates(["id", "ref"]), F.col("id"), "DERIVED_FROM", source, provenance=F.concat(said, F.lit("#sources:"), "ref")))
    )


def verify_sources(references: DataFrame, files: DataFrame) -> DataFrame:
    """(page, ref, finding) of references (page, ref, sha256) against files (path, sha256): fine, broken or drifted."""
    j = references.join(files.select(F.col("path").alias("ref"), F.col("sha256").alias("now")), "ref", "left")
    return j.select("page", "ref", F.when(F.col("now").isNull(), "broken").when(F.col("sha256") != F.col("now"), "drifted").otherwise("fine").alias("finding"))


def finalize_plan(plan: DataFrame, files: DataFrame) -> DataFrame:
    """(path, action, problem): whether a plan (path, sha256, keep) to publish final files holds; nothing is moved here.

    Every file has to be planned, and every planned one there with the hash that the plan was made for.
    """
    j = plan.select("path", F.col("sha256").alias("was"), "keep").join(files.select("path", F.col("sha256").alias("now")), "path", "full")
    problem = F.when(F.col("was").isNull(), "not_planned").when(F.col("now").isNull(), "missing").when(F.col("was") != F.col("now"), "changed")
    return j.select("path", F.when(F.col("keep"), "publish").otherwise("remove").alias("action"), problem.alias("problem"))


def attestations(assessed: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Events that record, for closed sessions (session, source, sha256) with knowledge (session) in the graph, that they may be cleaned up."""
    fine = assessed.join(knowledge.select("session").distinct(), "session", "left_semi")
    return upserts(fine, id=F.concat(F.lit("attestation:"), "session"), type=F.lit("Attestation"), label=F.col("session"), content_sha256=F.col("sha256"), provenance=F.col("source"))


def purge_events(attempts: DataFrame) -> DataFrame:
    """(op, payload) that record tries to purge sessions (session, source, sha256, error, at): an attempt, and a failure where error says why."""
    common = [F.col("session"), F.col("source"), F.col("sha256"), F.col("at")]
    made = lambda kind, *more: F.to_json(F.struct(F.concat(F.lit(f"purge-{kind}:"), F.substring(F.sha2(F.concat_ws("|", "session", "source", "sha256", "at").cast("binary"), 256), 1, 16)).alias("id"), F.lit("Event").alias("type"), F.lit(f"purge_{kind}").alias("label"), *common, *more))
    tried = attempts.select(F.lit("node.upsert").alias("op"), made("attempt").alias("payload"))
    return tried.union(attempts.where("error is not null").select(F.lit("node.upsert"), made("failure", F.col("error"))))
