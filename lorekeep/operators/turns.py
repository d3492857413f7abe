"""Pages, views and pruning of transcripts. A transcript is (session, line, role, content), line counting from 1."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_empty_search


def by_session():
    """A session's rows in order."""
    return Window.partitionBy("session").orderBy("line")


def page(turns: DataFrame, offset: int, limit: int) -> DataFrame:
    """Each session's rows after offset, limit of them (1 to 100), with next_offset: the last line shown if more follow, else null."""
    if not 1 <= limit <= 100:
        raise ValueError("limit is 1 to 100")
    later = turns.where(F.col("line") > offset).withColumn("n", F.row_number().over(by_session())).where(F.col("n") <= limit + 1)
    whole = Window.partitionBy("session")
    return (
        later.withColumn("more", F.max("n").over(whole) > limit).where(F.col("n") <= limit)
        .withColumn("next_offset", F.when(F.col("more"), F.max("line").over(whole))).drop("n", "more")
    )


def exact_lines(turns: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, absent): stated (session, line) pairs that are there, and those that are not."""
    return turns.join(wanted.distinct(), ["session", "line"], "left_semi"), wanted.distinct().join(turns, ["session", "line"], "left_anti")


def tail(turns: DataFrame, lines: int = 200) -> DataFrame:
    """Each session's last lines."""
    back = Window.partitionBy("session").orderBy(F.desc("line"))
    return turns.withColumn("back", F.row_number().over(back)).where(F.col("back") <= lines).drop("back")


def bounded_scan(turns: DataFrame, most_bytes: int, most_records: int) -> DataFrame:
    """Each session's first records within both bounds, with the bytes so far."""
    w = by_session().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = turns.withColumn("bytes", F.sum(F.octet_length("content")).over(w)).withColumn("n", F.row_number().over(by_session()))
    return sized.where((F.col("bytes") <= most_bytes) & (F.col("n") <= most_records)).drop("n")


def dialogue(turns: DataFrame) -> DataFrame:
    """What was said by the two sides, without white space around it."""
    return turns.where(F.col("role").isin("user", "assistant") & (F.trim("content") != ""))


def preview(content: Column, chars: int = 120) -> Column:
    """A text of at most chars, else its first and last halves; never a summary."""
    half = chars // 2
    return F.when(F.length(content) <= chars, content).otherwise(F.concat(F.substring(content, 1, half), F.lit("…"), F.right(content, F.lit(half))))


def index_view(turns: DataFrame) -> DataFrame:
    """Navigation rows: a preview and the length of what it stands for."""
    return turns.select("session", "line", "role", preview(F.col("content")).alias("preview"), F.length("content").alias("chars"), (F.length("content") > 120).alias("truncated"))


def line_ranges(lines: DataFrame, by: str = "session") -> DataFrame:
    """(by, ranges): distinct line numbers as `30,32,76-78`."""
    run = lines.select(by, "line").distinct().withColumn("island", F.col("line") - F.row_number().over(Window.partitionBy(by).orderBy("line")))
    spans = run.groupBy(by, "island").agg(F.min("line").alias("lo"), F.max("line").alias("hi"))
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    listed = spans.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("lo", text.alias("text")))).alias("s"))
    return listed.select(by, F.array_join("s.text", ",").alias("ranges"))


def adjacent_dispatch(events: DataFrame) -> DataFrame:
    """(session, line, dispatch): results right after the dispatch that they answer; role is `tool_dispatch` or `tool`."""
    before = F.lag(F.struct("role", "line")).over(by_session())
    return events.withColumn("b", before).where((F.col("role") == "tool") & (F.col("b.role") == "tool_dispatch")).select("session", "line", F.col("b.line").alias("dispatch"))


def paired(calls: DataFrame, outputs: DataFrame) -> DataFrame:
    """Calls (session, line, call_id, action, target) with their outputs (session, line, call_id, content, is_error) by id; the first call of an id counts."""
    first = calls.where("call_id is not null").groupBy("session", "call_id").agg(F.min_by(F.struct("line", "action", "target"), "line").alias("c"))
    once = outputs.groupBy("session", "call_id").agg(F.min_by(F.struct("line", "content", "is_error"), "line").alias("o"))
    return first.join(once, ["session", "call_id"]).select(
        "session", "call_id", "c.action", "c.target", F.col("c.line").alias("call_line"), F.col("o.line").alias("line"), "o.content", "o.is_error"
    )


def paired_in_order(calls: DataFrame, outputs: DataFrame, near: int = 2) -> DataFrame:
    """(session, call_line, line, way): outputs (session, line, call_id, call_line) claimed by calls (session, line, call_id), each once.

    First by id, then by the line that an output names, then by standing within `near` lines after a call. A later way
    only takes what the earlier ones left, so a session is paired as a whole.
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        calls_, outs = left.sort_values("line").to_dict("records"), right.sort_values("line").to_dict("records")
        done: dict[int, tuple[int, str]] = {}
        taken: set[int] = set()
        ways = {
            "id": lambda c, o: c["call_id"] is not None and c["call_id"] == o["call_id"],
            "line": lambda c, o: o["call_line"] == c["line"],
            "near": lambda c, o: 0 < o["line"] - c["line"] <= near,
        }
        for way, fits in ways.items():
            for c in calls_:
                if c["line"] in done:
                    continue
                hit = next((o["line"] for o in outs if o["line"] not in taken and fits(c, o)), None)
                if hit is not None:
                    done[c["line"]] = (hit, way)
                    taken.add(hit)
        return pd.DataFrame([(key[0], c, o, w) for c, (o, w) in sorted(done.items())], columns=["session", "call_line", "line", "way"])

    a, b = calls.select("session", "line", "call_id"), outputs.select("session", "line", "call_id", "call_line")
    return a.groupBy("session").cogroup(b.groupBy("session")).applyInPandas(run, "session string, call_line long, line long, way string")


#: Tools that write a plan, and where its items and their fields are.
PLAN_TOOLS = ("update_plan", "todowrite", "todo_write", "write_todos", "manage_todo_list", "update_todo_list")


def plan_writes(calls: DataFrame) -> DataFrame:
    """(session, line, call_id, items) of plan writes in calls (session, line, call_id, name, arguments): each item's words and state."""
    from ..functions.text import status_word

    kind = "array<struct<content:string,step:string,title:string,text:string,status:string,state:string>>"
    raw = F.coalesce(*(F.from_json(F.get_json_object("arguments", f"$.{k}"), kind) for k in ("plan", "todos", "items", "todoList", "tasks")))
    item = lambda i: F.struct(F.coalesce(i["content"], i["step"], i["title"], i["text"]).alias("content"), F.coalesce(status_word(F.coalesce(i["status"], i["state"])), F.lit("unknown")).alias("status"))
    rows = calls.where(F.lower("name").isin(*PLAN_TOOLS)).select("session", "line", "call_id", F.filter(F.transform(raw, item), lambda i: F.trim(i["content"]) != "").alias("items"))
    return rows.where(F.size("items") > 0)


def outstanding(items: Column) -> Column:
    """(current, next, open): the item in progress, the first pending one, and how many of both there are."""
    of = lambda s: F.filter(items, lambda i: i["status"] == s)
    doing, waiting = of("in_progress"), of("pending")
    return F.struct(F.get(doing, F.lit(0))["content"].alias("current"), F.get(waiting, F.lit(0))["content"].alias("next"), (F.size(doing) + F.size(waiting)).alias("open"))


def prune_decisions(tools: DataFrame, writes: DataFrame, newest: DataFrame, keep: int = 4) -> DataFrame:
    """(session, line, rule, target, by_line): tool outputs that later work made stale.

    tools: session, action (read or search), target, call_line, line, content, is_error; writes: session, target,
    line; newest: session, last (the session's last line). A read goes if its target is written later, or read again
    with no write in between; an empty search goes. Errors and the newest lines stay.
    """
    old = tools.join(newest, "session").where(~F.col("is_error") & (F.col("line") <= F.col("last") - keep))
    reads = tools.where("action = 'read'").select("session", "target", F.col("line").alias("at"), F.col("call_line").alias("call_at"), F.lit("r").alias("kind"))
    marks = reads.union(writes.select("session", "target", F.col("line").alias("at"), F.col("line").alias("call_at"), F.lit("w").alias("kind")))
    ahead = Window.partitionBy("session", "target").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    seen = marks.withColumn("next_write", F.min(F.when(F.col("kind") == "w", F.col("at"))).over(ahead)).withColumn("next_read", F.min(F.when(F.col("kind") == "r", F.struct("at", "call_at"))).over(ahead))
    known = seen.where("kind = 'r'").select("session", "target", F.col("at").alias("line"), "next_write", "next_read")
    read = old.where("action = 'read'").join(known, ["session", "target", "line"])
    superseded = read.where("next_write is not null").select("session", "line", F.lit("superseded_read").alias("rule"), "target", F.col("next_write").alias("by_line"))
    again = read.where("next_write is null and next_read is not null").select("session", "line", F.lit("duplicate_read").alias("rule"), "target", F.col("next_read.at").alias("by_line"))
    empty = old.where((F.col("action") == "search") & is_empty_search(F.col("content"))).select("session", "line", F.lit("empty_search").alias("rule"), "target", F.lit(None).cast("long").alias("by_line"))
    return superseded.unionByName(again.withColumn("by_line", F.col("by_line").cast("long"))).unionByName(empty)


def latest_by_role(turns: DataFrame) -> DataFrame:
    """(session, role, line, content): each side's last words."""
    return turns.groupBy("session", "role").agg(F.max_by(F.struct("line", "content"), "line").alias("t")).select("session", "role", "t.line", "t.content")


MARKERS = {"blocked": r"\b(?:blocked|blocker)\b", "failed": r"\b(?:failed|failure)\b", "pending": r"\bpending\b", "queued": r"\bqueued\b"}


def open_markers(turns: DataFrame) -> DataFrame:
    """(session, line, marker): words of open work in each side's last words."""
    last = latest_by_role(turns)
    found = F.filter(F.array(*[F.when(F.lower("content").rlike(p), F.lit(m)) for m, p in MARKERS.items()]), lambda x: x.isNotNull())
    return last.select("session", "line", F.explode(found).alias("marker"))


def task_state(writes: DataFrame) -> DataFrame:
    """(session, line, confirmed, items): the last confirmed plan of each session, else the newest unconfirmed one.

    writes: session, line, items (array of structs), confirmed.
    """
    order = F.struct(F.col("confirmed").cast("int"), "line")
    return writes.groupBy("session").agg(F.max_by(F.struct("line", "confirmed", "items"), order).alias("s")).select("session", "s.*")


def native_kind(event: Column) -> Column:
    """What a native event (JSON) calls itself: type, refined by payload.type; `other` without one."""
    kind = F.coalesce(F.get_json_object(event, "$.type"), F.lit("other"))
    return F.concat_ws(":", kind, F.get_json_object(event, "$.payload.type"))


#: What names an event and places it in time. Fixed values.
IDENTITY = ("id", "message_id", "turn_id", "uuid", "step_index", "created_at", "timestamp", "status", "type", "parentUuid", "truncated_fields", "ordinal")


def identity(event: Column) -> Column:
    """The identity fields that an event (JSON) has, as a map."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.get_json_object(event, f"$.{k}").alias("value")) for k in IDENTITY])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def tally(rows: DataFrame) -> DataFrame:
    """(session, elided, truncated, ranges): of rows (session, line, kind, shown, truncated) what a view leaves out, `kindxn` by kind,
    and how many shown rows have text that their source cut, with their lines. Sessions without either have no row."""
    left = rows.where(~F.col("shown")).groupBy("session", "kind").agg(F.count("*").alias("n"))
    said = left.groupBy("session").agg(F.array_join(F.array_sort(F.collect_list(F.concat("kind", F.lit("x"), "n"))), ",").alias("elided"))
    cut = rows.where(F.col("shown") & F.col("truncated")).select("session", "line")
    spans = line_ranges(cut).join(cut.groupBy("session").agg(F.count("*").alias("truncated")), "session")
    return said.join(spans, "session", "full").select("session", "elided", F.coalesce("truncated", F.lit(0)).alias("truncated"), "ranges")


def apply_notes(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows (session, line, content, preview) with a note in the place of what decisions (session, line, rule) prune.

    pruned and prune_reason say so, omitted_chars how long the content was; of several rules of a row the first by name counts.
    """
    why = decisions.groupBy("session", "line").agg(F.min("rule").alias("prune_reason"))
    j = rows.join(why, ["session", "line"], "left").withColumn("pruned", F.col("prune_reason").isNotNull())
    note = lambda before: F.concat(F.lit(before), "prune_reason", F.lit("]"))
    return j.withColumns({
        "omitted_chars": F.when(F.col("pruned"), F.length("content")), "content": F.when(F.col("pruned"), note("[tool output omitted: ")).otherwise(F.col("content")),
        "preview": F.when(F.col("pruned"), note("[omitted: ")).otherwise(F.col("preview")),
    })


def context_view(event: Column) -> Column:
    """struct(form, role, content, nontext, phase) of an event (JSON) of the one dialect that has this view; null where nothing is shown.

    Whole events stay for compactions, errors and anything unknown; a message of either side is dialogue, with the kinds of its
    parts that are no text; calls and their outputs are previews; reasoning and instructions of the system are left out.
    """
    g = lambda path: F.get_json_object(event, f"$.{path}")
    kind, inner, role = g("type"), g("payload.type"), g("payload.role")
    parts = F.from_json(g("payload.content"), "array<struct<type:string,text:string>>")
    texts = ("text", "input_text", "output_text")
    said = F.array_join(F.transform(F.filter(parts, lambda p: p["type"].isin(*texts)), lambda p: p["text"]), "\n")
    other = F.transform(F.filter(parts, lambda p: ~F.coalesce(p["type"], F.lit("unknown")).isin(*texts)), lambda p: F.coalesce(p["type"], F.lit("unknown")))
    none = F.lit(None).cast("string")
    made = lambda form, who, text, rest, phase: F.struct(F.lit(form).alias("form"), who.alias("role"), text.alias("content"), rest.alias("nontext"), phase.alias("phase"))
    no_parts = F.expr("cast(null as array<string>)")
    whole = made("event", none, event, no_parts, none)
    item = kind == "response_item"
    return (
        F.when((kind == "compacted") | ((kind == "event_msg") & inner.isin("error", "warning", "turn_aborted")), whole)
        .when(item & (inner == "message") & role.isin("user", "assistant"), made("dialogue", role, F.coalesce(said, F.lit("")), other, g("payload.phase")))
        .when(item & inner.isin("function_call", "custom_tool_call", "local_shell_call"), made("preview", none, preview(F.coalesce(g("payload.arguments"), g("payload.input"), F.lit(""))), no_parts, none))
        .when(item & inner.isin("function_call_output", "custom_tool_call_output"), made("preview", none, preview(F.coalesce(g("payload.output"), F.lit(""))), no_parts, none))
        .when(item & (inner != "reasoning") & (inner != "message"), whole)
    )
