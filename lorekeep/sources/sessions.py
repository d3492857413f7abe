"""Finding sessions: where tools keep them, and what a folder of files says about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .transcripts import is_session_id

#: Where each tool keeps its sessions below a home folder, and what kind of store it is. Fixed values.
STORES = (
    ("codex", ".codex/sessions", "lines"), ("codex", ".codex/archived_sessions", "lines"), ("claude", ".claude/projects", "lines"), ("qwen", ".qwen/projects", "lines"),
    ("gemini", ".gemini/tmp", "document"), ("grok", ".grok/sessions", "lines"), ("copilot", ".copilot/session-state", "lines"), ("cursor", ".cursor/projects", "lines"),
    ("opencode", ".local/share/opencode", "database"), ("kilo", ".local/share/kilo", "database"), ("kiro", ".kiro/sessions", "lines"), ("mcode", ".minimax/v2/sqlite", "database"),
    ("freebuff", ".config/manicode/projects", "document"), ("freebuff", ".config/freebuff-desktop/projects", "document"),
    ("antigravity", ".gemini/antigravity-cli/brain", "lines"), ("antigravity", ".gemini/antigravity/brain", "lines"), ("antigravity", ".gemini/antigravity-ide/brain", "lines"),
    *(("vscode", f"{base}/{app}/User/workspaceStorage", "document") for app in ("Code", "Code - Insiders", "VSCodium") for base in ("Library/Application Support", ".config")),
)


def stores(spark: SparkSession) -> DataFrame:
    """(source, folder, kind) of the known stores."""
    return spark.createDataFrame(list(STORES), "source string, folder string, kind string")


def project_folder(path: str) -> str:
    """How tools that name a folder after a project write its path."""
    return "".join(c if c.isascii() and c.isalnum() else "-" for c in path)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, bytes) of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified"), F.col("length").alias("bytes"))


def candidates(files: DataFrame) -> DataFrame:
    """(source, id, project, path, modified, bytes) of listed files that are sessions of a known store.

    The id is the file's name, or its folder's if the name is generic; in dated names it is the trailing id. The project
    is the folder below `projects`, as written there.
    """
    source = F.lit(None).cast("string")
    for name, folder, _ in STORES:
        source = F.when(F.col("path").contains(f"/{folder}/"), F.lit(name)).otherwise(source)
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.(?:jsonl(?:\.zst)?|json)\z", "")
    parent = F.element_at(F.split("path", "/"), -2)
    generic = base.isin("transcript", "chat_history", "messages", "events", "session", "chat")
    tail = F.regexp_extract(base, r"([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})\z", 1)
    ident = F.when(generic, parent).when(tail != "", tail).otherwise(base)
    project = F.nullif(F.regexp_extract("path", r"/projects/([^/]+)/", 1), F.lit(""))
    rows = files.where(F.col("path").rlike(r"\.jsonl?(?:\.zst)?\z")).select(source.alias("source"), ident.alias("id"), project.alias("project"), "path", "modified", "bytes")
    return rows.where(F.col("source").isNotNull() & is_session_id(F.col("id")))


def database_candidates(rows: DataFrame, source: str) -> DataFrame:
    """Candidates of a session table (id, directory, time_updated in milliseconds, parent_id) read from a database."""
    at = F.date_format(F.timestamp_millis("time_updated"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.where(is_session_id(F.col("id"))).select(F.lit(source).alias("source"), "id", F.col("directory").alias("project"), F.lit(None).cast("string").alias("path"), at.alias("modified"), F.lit(None).cast("long").alias("bytes"), F.col("parent_id").alias("parent"))


def of_project(found: DataFrame, variants: DataFrame) -> DataFrame:
    """Candidates of one project, by the ways its path (path, folder) may be written."""
    v = variants.select(F.col("path").alias("project")).union(variants.select("folder")).distinct()
    return found.join(F.broadcast(v), "project", "left_semi")


def locate(found: DataFrame, ident: str) -> dict:
    """The one candidate of an id or of a prefix of eight characters; several or none are an error that says which."""
    rows = found.where((F.col("id") == ident) | (F.lit(len(ident) >= 8) & F.col("id").startswith(ident))).limit(11).collect()
    if len(rows) != 1:
        raise LookupError(f"unknown session {ident}" if not rows else f"ambiguous session {ident}: {', '.join(sorted(r['id'] for r in rows))}")
    return rows[0].asDict()


def pickup(found: DataFrame, reasons: DataFrame) -> dict:
    """The one open session to go on with: its id, or that there is none, or which there are."""
    rows = found.join(reasons.select(F.col("session").alias("id"), "reasons", "confidence"), "id").orderBy(F.desc("modified"), "id").limit(11).collect()
    if not rows:
        return {"resolution": "not_found"}
    if len(rows) > 1:
        return {"resolution": "ambiguous", "candidates": [r["id"] for r in rows]}
    return {"resolution": "found", "id": rows[0]["id"], "reasons": rows[0]["reasons"], "confidence": rows[0]["confidence"]}


def coverage(spark: SparkSession, present: DataFrame, wanted: str | None = None) -> DataFrame:
    """(source, folder, state): which stores (folder) were looked into, left out by the wanted source, or aren't there."""
    there = present.select("folder").distinct().withColumn("there", F.lit(True))
    skipped = F.col("source") != F.lit(wanted) if wanted else F.lit(False)
    return stores(spark).join(there, "folder", "left").select("source", "folder", F.when(skipped, "skipped").when(F.col("there"), "scanned").otherwise("missing").alias("state"))


def latest_times(events: DataFrame) -> DataFrame:
    """(session, latest): the largest of the times that events (session, event) carry."""
    times = [F.get_json_object("event", f"$.{k}") for k in ("timestamp", "created_at", "ts", "payload.timestamp")]
    return events.groupBy("session").agg(F.max(F.greatest(*times)).alias("latest"))


def first_meta(events: DataFrame) -> DataFrame:
    """(session, cwd, id): what the first line of a rollout says about its session."""
    first = events.groupBy("session").agg(F.min_by("event", "line").alias("e"))
    get = lambda k: F.get_json_object("e", f"$.payload.{k}")
    return first.where(F.get_json_object("e", "$.type") == "session_meta").select("session", get("cwd").alias("cwd"), get("id").alias("id"))


def outcomes(events: DataFrame) -> DataFrame:
    """(session, line, kind) of the terminal marks in native events (session, source, line, event)."""
    g = lambda p: F.get_json_object("event", f"$.{p}")
    src, kind, payload = F.col("source"), g("type"), g("payload.type")
    code = F.coalesce(g("payload.output.exit_code").try_cast("int"), F.regexp_extract(g("payload.output"), r"(?m)^Process exited with code (-?\d+)", 1).try_cast("int"))
    mark = (
        F.when((src == "codex") & (payload == "task_complete"), "completed").when((src == "codex") & (payload.isin("turn_aborted", "error") | (g("status") == "cancelled")), "interrupted")
        .when((src == "codex") & payload.isin("function_call_output", "custom_tool_call_output") & code.isNotNull(), F.when(code == 0, "exit_ok").otherwise("exit_failed"))
        .when((src == "copilot") & (kind == "assistant.turn_start"), "started").when((src == "copilot") & (kind == "assistant.turn_end"), "completed").when((src == "copilot") & (kind == "abort"), "interrupted")
        .when((src == "copilot") & (kind == "tool.execution_complete"), F.when(g("data.success") == "false", "tool_failed").when(g("data.success") == "true", "tool_ok"))
        .when((src == "claude") & (g("isSidechain") == "true"), F.lit(None)).when((src == "claude") & (g("isApiErrorMessage") == "true"), "interrupted")
        .when((src == "claude") & (g("message.stop_reason") == "end_turn"), "completed").when((src == "claude") & g("message.stop_reason").isNotNull(), "interrupted")
        .when((src == "antigravity") & g("status").isin("CANCELLED", "ERROR"), "interrupted").when((src == "antigravity") & (g("status") == "DONE"), "completed")
    )
    return events.withColumn("kind", mark).where("kind is not null").select("session", "line", "kind")


