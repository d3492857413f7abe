"""What to hand over of a session: a brief, a digest of what was done, payloads left out by reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cues
from ..functions.text import exit_code
from .turns import line_ranges, preview


def brief(turns: DataFrame, chars: int = 600) -> DataFrame:
    """(session, request, request_line, answer, answer_line, turns, answered): the last words of both sides, cut, and whether the request was answered."""
    typed = turns.where((F.col("role") != "user") | ~cues.is_injected(F.col("content")))
    last = lambda role: F.max_by(F.struct("line", "content"), F.when(F.col("role") == role, F.col("line")))
    rows = typed.groupBy("session").agg(last("user").alias("u"), last("assistant").alias("a"), F.count("*").alias("turns"))
    return rows.select(
        "session", preview(F.col("u.content"), chars).alias("request"), F.col("u.line").alias("request_line"), preview(F.col("a.content"), chars).alias("answer"), F.col("a.line").alias("answer_line"),
        "turns", F.coalesce(F.col("a.line") > F.col("u.line"), F.lit(False)).alias("answered"),
    )


def user_turns(turns: DataFrame) -> DataFrame:
    """What a person typed, without what a tool put under the user's role."""
    return turns.where((F.col("role") == "user") & ~cues.is_injected(F.col("content")) & (F.trim("content") != ""))


def digest(turns: DataFrame, calls: DataFrame, results: DataFrame) -> DataFrame:
    """One row a session: lines of user turns, files written and read, searches, failures, approval claims.

    calls: session, line, action, target; results: session, line, content.
    """
    lines = lambda rows, name: line_ranges(rows.select("session", "line")).withColumnRenamed("ranges", name)
    failed = results.withColumn("code", exit_code(F.col("content"))).where("code is not null and code <> 0")
    spoken = turns.select("session", "line", F.explode(F.split("content", "[.。!！?？\n]")).alias("sentence")).where(cues.approval_claim(F.col("sentence")))
    files = lambda action, name: calls.where(F.col("action") == action).groupBy("session").agg(F.array_sort(F.collect_set("target")).alias(name))
    out = turns.select("session").distinct()
    for part in (lines(user_turns(turns), "asked"), files("write", "written"), files("read", "read"), files("search", "searched"), lines(failed, "failed"), lines(spoken, "claims")):
        out = out.join(part, "session", "left")
    return out


def deliveries(turns: DataFrame) -> DataFrame:
    """(session, line, path): files that answers point to."""
    return turns.where("role = 'assistant'").select("session", "line", F.explode(F.array_distinct(cues.delivered_paths(F.col("content")))).alias("path"))


def folders(paths: DataFrame) -> DataFrame:
    """(session, folder, files): delivered paths by the folder that they are in."""
    folder, name = F.regexp_extract("path", r"\A(.*)/[^/]*\z", 1), F.element_at(F.split("path", "/"), -1)
    return paths.groupBy("session", folder.alias("folder")).agg(F.array_sort(F.collect_set(name)).alias("files"))


def externalize(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, attachments): image payloads of records (session, line, content) replaced by a reference to their hash."""
    image = cues.image_uri(F.col("content"))
    sha = F.sha2(F.col("content").cast("binary"), 256)
    kept = records.withColumn("content", F.when(image, F.concat(F.lit("attachment:"), sha)).otherwise(F.col("content")))
    return kept, records.where(image).select("session", "line", sha.alias("sha256"), F.octet_length("content").alias("bytes"))


def resolve(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """(session, line, content, problem) of wanted attachments (session, line, sha256): the payload, if it is still the one that was left out."""
    j = wanted.join(records, ["session", "line"], "left")
    same = F.sha2(F.col("content").cast("binary"), 256) == F.col("sha256")
    return j.select("session", "line", F.when(same, F.col("content")).alias("content"), F.when(F.col("content").isNull(), "absent").when(~same, "changed").alias("problem"))


def smallest(page: Column, *forms: Column) -> Column:
    """The shortest of a page's forms in bytes, the first of equals."""
    sized = F.array(*[F.struct(F.octet_length(f).alias("bytes"), F.lit(n).alias("n"), f.alias("form")) for n, f in enumerate((page, *forms))])
    return F.array_min(sized)["form"]


def history_of(journal: DataFrame, node: str) -> DataFrame:
    """(seq, observed_utc, op, payload) of the events that touch a node, in order."""
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    return journal.where((get("id") == node) | (get("from") == node) | (get("to") == node)).orderBy("seq")


def profile(fields: dict[str, str]) -> str:
    """A profile page; absent fields are empty."""
    return f"# {fields.get('title', '')}\n\n{fields.get('blurb', '')}\n\nstatus: {fields.get('status', '')}\n"


def render_brief(tasks: list[dict]) -> str:
    """A task brief as text, with a note if the status of any task is unknown."""
    lines = [f"- [{t['status']}] {t['label']} ({t['id']})" + (f" <- {', '.join(t['projects'])}" if t["projects"] else "") for t in tasks]
    unknown = sum(t["status"] == "unknown" for t in tasks)
    return "\n".join(lines + ([f"{unknown} with unknown status: that doesn't prove that work is open"] if unknown else []))
