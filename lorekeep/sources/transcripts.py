"""Transcripts of fourteen tools as one relation: (session, source, line, role, content) from native JSON events.

A native event is one JSON text; each dialect says where the role and the words are. Selectors are fixed values.
"""

from __future__ import annotations

from itertools import count, islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import file_lines

SOURCES = ("antigravity", "claude", "codex", "copilot", "cursor", "freebuff", "gemini", "grok", "kilo", "kiro", "mcode", "opencode", "qwen", "vscode")
#: Extensions of the files that hold transcripts, and what reads them.
FILE_KINDS = {"jsonl": "lines", "jsonl.zst": "lines", "json": "document"}
#: A session id: a UUID, a prefixed token, or a dated name.
SESSION_ID = r"\A(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|(?:ses|sess|mvs)_[A-Za-z0-9_-]+|[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9.:-]+Z)\z"


def is_session_id(s: Column) -> Column:
    return F.coalesce(s.rlike(SESSION_ID), F.lit(False))


def _get(event: Column, path: str) -> Column:
    return F.get_json_object(event, f"$.{path}")


def words(value: Column) -> Column:
    """The words of a content: a string as it is, of an array of parts the text ones, thoughts left out, line by line."""
    parts = F.from_json(value, "array<struct<type:string,text:string,thought:boolean>>")
    plain = F.from_json(value, "array<string>")
    said = F.filter(parts, lambda p: p["text"].isNotNull() & F.coalesce(p["type"].isin("text", "input_text", "output_text"), F.lit(True)) & ~F.coalesce(p["thought"], F.lit(False)))
    texts = F.transform(said, lambda p: p["text"])
    listed = value.startswith("[") & (parts.isNotNull() | plain.isNotNull())
    return F.when(listed & (F.size(texts) > 0), F.array_join(texts, "\n")).when(listed & value.startswith('["'), F.array_join(plain, "\n")).when(listed, F.lit(None)).otherwise(value)


def request_text(content: Column) -> Column:
    """The user's words inside a request envelope, or the content without one."""
    inner = F.regexp_extract(content, r"(?s)<USER_REQUEST>\s*(.*?)\s*</USER_REQUEST>", 1)
    return F.when(inner != "", inner).otherwise(content)


def spoken(source: Column, event: Column) -> Column:
    """struct(role, content) of what a person, the assistant or a command said in an event; null for any other event."""
    g = lambda path: _get(event, path)
    made = lambda role, content: F.when(role.isin("user", "assistant", "tool") & content.isNotNull() & (F.trim(content) != ""), F.struct(role.alias("role"), content.alias("content")))
    kind = g("type")
    user_or = lambda user, other: F.when(kind == user, "user").when(kind == other, "assistant")
    message = F.coalesce(g("message.role"), g("role"), kind)
    run = (kind == "item_completed") & (F.coalesce(g("item.type"), g("payload.type")) == "command_execution")
    output = F.coalesce(*(g(f"{at}.{k}") for at in ("item", "payload") for k in ("aggregated_output", "output", "stdout", "stderr")))
    codex = F.when(run, made(F.lit("tool"), output)).when((kind == "response_item") & (g("payload.type") == "message"), made(g("payload.role"), words(g("payload.content"))))
    ways = {
        ("antigravity",): made(user_or("USER_INPUT", "PLANNER_RESPONSE"), request_text(g("content"))),
        ("codex",): codex,
        ("claude", "cursor", "mcode"): made(message, words(F.coalesce(g("message.content"), g("content")))),
        ("qwen",): made(user_or("user", "assistant"), words(g("message.parts"))),
        ("grok",): made(F.coalesce(g("role"), kind), words(g("content"))),
        ("copilot",): made(user_or("user.message", "assistant.message"), words(g("data.content"))),
        ("gemini",): made(user_or("user", "gemini"), words(g("content"))),
        ("opencode", "kilo"): made(g("message.role"), words(g("parts"))),
        ("kiro",): made(F.when(g("payload.type").isin("user", "assistant"), g("payload.type")), words(g("payload.content"))),
        ("freebuff",): made(F.coalesce(g("role"), F.when(g("variant") == "user", "user").when(g("variant").isin("ai", "agent", "assistant"), "assistant")), words(F.coalesce(g("parts_json"), g("blocks"), g("content")))),
    }
    out = F.lit(None)
    for names, said in ways.items():
        out = F.when(source.isin(*names), said).otherwise(out)
    return out


def dialogue(events: DataFrame) -> DataFrame:
    """(session, source, line, role, content) of events (session, source, line, event); a vscode request gives two rows, user before assistant."""
    pair = F.from_json(_get(F.col("event"), "response"), "array<struct<content:struct<value:string>,value:string>>")
    answer = F.array_join(F.filter(F.transform(pair, lambda p: F.coalesce(p["content"]["value"], p["value"])), lambda x: x.isNotNull()), "\n")
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    both = F.array(said("user", _get(F.col("event"), "message.text")), said("assistant", answer))
    vscode = events.where("source = 'vscode'").select("session", "source", "line", F.posexplode(both).alias("part", "s"))
    vscode = vscode.where("s.content is not null and s.content <> ''").select("session", "source", "line", "part", "s.role", "s.content")
    rest = events.where("source <> 'vscode'").withColumn("s", spoken(F.col("source"), F.col("event"))).where("s is not null")
    return rest.select("session", "source", "line", F.lit(0).alias("part"), "s.role", "s.content").union(vscode)


def tool_calls(events: DataFrame) -> DataFrame:
    """(session, line, call_id, action, target): calls of events (session, line, event) that read, write, search or check a status."""
    call = lambda prefix: F.struct(*(_get(F.col("event"), f"{prefix}{k}").alias(k) for k in ("type", "call_id", "id", "name", "arguments", "input")))
    rows = events.select("session", "line", F.explode(F.array(call(""), call("payload."))).alias("c")).where("c.name is not null and c.type in ('function_call', 'custom_tool_call', 'tool_use', 'tool_call')")
    args = F.coalesce("c.arguments", "c.input")
    name = F.lower("c.name")
    at = lambda *keys: F.coalesce(*(F.nullif(F.trim(F.get_json_object(args, f"$.{k}")), F.lit("")) for k in keys))
    path = F.regexp_replace(F.regexp_replace(at("file_path", "path", "file", "AbsolutePath", "TargetFile", "target"), "\\A['\"]|['\"]\\z", ""), r"\A\./", "")
    command = at("command", "cmd", "CommandLine")
    shown = F.regexp_extract(command, r"\A(?:cat|head|tail|bat)\s+([^-\s]\S*)", 1)
    shell = name.isin("exec_command", "bash", "sh")
    action = (
        F.when(name.isin("read_file", "view_file", "view", "read", "cat") & path.isNotNull(), "read").when(name.isin("write_to_file", "replace_file_content", "edit", "write", "write_file", "apply_patch", "str_replace_editor") & path.isNotNull(), "write")
        .when(name.isin("grep_search", "find_by_name", "file_search", "grep", "glob", "find"), "search").when(shell & (shown != ""), "read").when(shell & command.isNotNull(), "status")
    )
    target = F.when(action == "search", F.coalesce(at("query", "pattern", "Query", "Pattern", "path"), F.lit(""))).when(shell & (shown != ""), shown).when(action == "status", command).otherwise(path)
    return rows.select("session", "line", F.coalesce("c.call_id", "c.id").alias("call_id"), action.alias("action"), target.alias("target")).where("action is not null")


def read_events(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(session, source, line, event) of all JSONL transcripts below path, .zst ones too; a line that is no JSON is skipped.

    The session is the file's name. Plain files of any size are split where Spark splits them; packed ones are unpacked as
    a stream, some thousand lines at a time.
    """
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.jsonl(?:\.zst)?\z", "")
    lines = file_lines(spark, path, "*.jsonl").union(_packed_lines(spark, path, "*.jsonl.zst"))
    return lines.where(F.try_parse_json("value").isNotNull() & (F.trim("value") != "")).select(name.alias("session"), F.lit(source).alias("source"), "line", F.col("value").alias("event"))


def _packed_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file, line, value) of zstandard files."""

    def run(batches):
        import io

        import pyarrow as pa
        import zstandard

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(content), encoding="utf-8", errors="replace", newline="\n")
                for at in count(0, 4_096):
                    some = [x.rstrip("\n") for x in islice(text, 4_096)]
                    if not some:
                        break
                    yield pa.RecordBatch.from_pydict({"file": pa.array([file] * len(some)), "line": pa.array(range(at + 1, at + 1 + len(some)), pa.int64()), "value": pa.array(some)})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInArrow(run, "file string, line long, value string")


def read_documents(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(session, source, line, event) of whole-document transcripts: the items of `messages` or `requests`, numbered from 1."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json\z", "").alias("session"), "value")
    items = F.from_json(F.coalesce(_get(F.col("value"), "messages"), _get(F.col("value"), "requests")), "array<string>")
    return files.select("session", F.lit(source).alias("source"), F.posexplode(items).alias("n", "event")).select("session", "source", (F.col("n") + 1).cast("long").alias("line"), "event")


def passages(docs: DataFrame, id_col: str, text: Column, chars: int = 4_096) -> DataFrame:
    """(id, line, part, role, text): a document's lines in pieces of at most so many characters; a heading that names a side gives the role of what follows."""
    from pyspark.sql import Window

    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("n", "line_text"))
    heading = F.lower(F.regexp_extract("line_text", r"(?i)\A#+\s*(user|assistant|system|tool)\b", 1))
    role = F.last(F.nullif(heading, F.lit("")), True).over(Window.partitionBy("id").orderBy("n"))
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("line_text") / chars).cast("int") - 1))
    said = lines.withColumn("role", role).where("trim(line_text) <> ''").select("id", (F.col("n") + 1).cast("long").alias("line"), "role", "line_text", F.explode(cuts).alias("part"))
    return said.select("id", "line", "part", "role", F.substring("line_text", F.col("part") * chars + 1, F.lit(chars)).alias("text"))
