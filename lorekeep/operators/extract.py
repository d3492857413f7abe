"""What a conversation says: decisions, blockers, requirements, deliverables, handoffs, its story.

Units are (session, line, role, content). Markers are looked for in lower-cased text, inside words too. Windows count
units, so all of a session's units take part; text is cut by bytes at a character.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V


def units_in_order():
    """A session's units in order, for windows that count units."""
    return Window.partitionBy("session").orderBy("line")


def cut_bytes(s: Column, most: int) -> Column:
    """A text of at most so many bytes: else as many characters as fit, and three dots."""
    data = s.cast("binary")
    # a character's later bytes begin with 10: step back to its first byte
    fits = F.array_max(F.filter(F.sequence(F.lit(max(0, most - 6)), F.lit(most - 3)), lambda n: ~F.hex(F.substring(data, n + 1, F.lit(1))).rlike("^[89AB]")))
    return F.when(F.octet_length(s) <= most, s).otherwise(F.concat(F.substring(data, F.lit(1), fits).cast("string"), F.lit("...")))


def holds(text: Column, markers) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(m) for m in markers))


def first_of(text: Column, rows, value: int = 1) -> Column:
    """The value of the first marker that a text holds."""
    out = F.lit(None)
    for row in reversed(rows):
        out = F.when(text.contains(row[0]), F.lit(row[value])).otherwise(out)
    return out


def sentence_with(content: Column, marker: Column, most: int) -> Column:
    """The first sentence that holds the marker, else the text."""
    said = F.filter(F.split(content, "[.。!！?？]"), lambda s: F.lower(s).contains(marker))
    return F.when(F.size(said) > 0, F.trim(F.get(said, F.lit(0)))).otherwise(cut_bytes(content, most))


def _low(units: DataFrame) -> DataFrame:
    return units.withColumn("low", F.lower("content"))


def decisions(units: DataFrame) -> DataFrame:
    """(session, line, category, summary, confirmed, confidence, rationale, trigger, alternatives)."""
    low = F.col("low")
    confirm = F.when((F.col("role") == "user") & holds(low, V.CONFIRMS), 1).otherwise(0)
    reason = F.when(holds(low, V.RATIONALES), cut_bytes(F.col("content"), 500))
    user = F.when(F.col("role") == "user", cut_bytes(F.col("content"), 200))
    other = F.when(holds(low, V.ALTERNATIVES), cut_bytes(F.col("content"), 200))
    seen = _low(units).select(
        "*", (F.max(confirm).over(units_in_order().rowsBetween(0, 9)) == 1).alias("confirmed"), F.last(reason, True).over(units_in_order().rowsBetween(-2, 0)).alias("rationale"),
        F.last(user, True).over(units_in_order().rowsBetween(Window.unboundedPreceding, -1)).alias("trigger"), F.collect_list(other).over(units_in_order().rowsBetween(-3, 2)).alias("alternatives"),
        first_of(low, V.DECISIONS, 0).alias("marker"), first_of(low, V.DECISIONS).alias("category"),
    )
    said = seen.where((F.col("role") == "assistant") & F.col("marker").isNotNull() & holds(low, V.DECIDES) & ~holds(low, V.ASKS))
    summary = cut_bytes(sentence_with(F.col("content"), F.col("marker"), 300), 300)
    return said.select("session", "line", "category", summary.alias("summary"), "confirmed", F.when(F.col("confirmed"), 0.9).otherwise(0.7).alias("confidence"), "rationale", "trigger", "alternatives")


def severity(text: Column, category: Column) -> Column:
    base = F.create_map(*[F.lit(x) for kv in V.SEVERITY.items() for x in kv])
    return F.least(F.lit(1.0), F.try_element_at(base, category) + F.when(holds(text, V.URGENT), 0.2).otherwise(0.0))


def blockers(units: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """(session, line, category, description, resolved, severity) of stated blockers and failed tools (session, line, name, output).

    A blocker is resolved if one of the fifteen units from it on says so.
    """
    low = F.col("low")
    seen = _low(units).select("*", (F.max(F.when(holds(low, V.RESOLVES), 1).otherwise(0)).over(units_in_order().rowsBetween(0, 14)) == 1).alias("resolved"), first_of(low, V.BLOCKERS).alias("category"))
    said = seen.where(F.col("category").isNotNull() & holds(low, V.BLOCKS)).select(
        "session", "line", "category", cut_bytes(F.col("content"), 300).alias("description"), "resolved", severity(low, F.col("category")).alias("severity")
    )
    if failures is None:
        return said
    out = F.lower("output")
    kind = (
        F.when(holds(out, ("permission", "access denied")), "permission").when(holds(out, ("not found", "missing")), "dependency")
        .when(holds(out, ("timeout",)), "resource").when(holds(out, ("compliance", "privacy", "個資")), "compliance").otherwise("technical")
    )
    text = F.concat(F.lit("Tool '"), "name", F.lit("' failed: "), cut_bytes(F.col("output"), 200))
    return said.union(failures.select("session", "line", kind.alias("category"), text.alias("description"), F.lit(False).alias("resolved"), severity(F.col("output"), kind).alias("severity")))


def requirements(units: DataFrame) -> DataFrame:
    """(session, line, signal, category, hard, requirement): one row for each signal in a user's words."""
    rows = F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(c).alias("category"), F.lit(h).alias("hard")) for s, c, h in V.REQUIREMENTS])
    hit = F.filter(rows, lambda r: F.col("low").contains(r["signal"]))
    return _low(units).where("role = 'user'").select("session", "line", F.explode(hit).alias("r"), cut_bytes(F.col("content"), 500).alias("requirement")).select("session", "line", "r.*", "requirement")


def deliverables(units: DataFrame) -> DataFrame:
    """(session, line, marker, kind, description, confirmed): one row for each marker in a user's words."""
    rows = F.array(*[F.struct(F.lit(m).alias("marker"), F.lit(k).alias("kind")) for m, k in V.DELIVERABLES])
    hit = F.filter(rows, lambda r: F.col("low").contains(r["marker"]))
    sure = holds(F.col("low"), ("confirm", "確認"))
    return _low(units).where("role = 'user'").select("session", "line", F.explode(hit).alias("r"), cut_bytes(F.col("content"), 500).alias("description"), sure.alias("confirmed")).select("session", "line", "r.*", "description", "confirmed")


def handoffs(units: DataFrame, last: int = 80) -> DataFrame:
    """(session, line, type, priority, explicit, instruction) from the user's words in each session's last units."""
    back = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("line")))
    low = F.col("low")
    seen = _low(units).withColumn("back", back).where((F.col("back") <= last) & (F.col("role") == "user") & holds(low, V.HANDS_OFF))
    marked = seen.withColumn("marker", first_of(low, V.HANDOFFS, 0)).where("marker is not null")
    text = sentence_with(F.col("content"), F.col("marker"), 300)
    return marked.select("session", "line", first_of(low, V.HANDOFFS, 1).alias("type"), first_of(low, V.HANDOFFS, 2).alias("priority"), first_of(low, V.HANDOFFS, 3).alias("explicit"), cut_bytes(text, 300).alias("instruction"))


def narrative(units: DataFrame) -> DataFrame:
    """(session, slot, line, section): where each slot first opens, and what is said from there on, by its number of units."""
    numbered = _low(units).withColumn("n", F.row_number().over(units_in_order()))
    opens = None
    for slot, (role, size, markers) in V.NARRATIVE.items():
        hit = holds(F.col("low"), markers) & (F.col("role") == role if role else F.lit(True))
        first = numbered.where(hit).groupBy("session").agg(F.min(F.struct("n", "line")).alias("f")).select("session", F.lit(slot).alias("slot"), F.lit(size).alias("size"), F.col("f.n").alias("at"), "f.line")
        opens = first if opens is None else opens.union(first)
    said = numbered.where("content <> '' and role <> 'system'").select("session", "n", "content")
    j = opens.join(said, (opens["session"] == said["session"]) & (said["n"] >= opens["at"]) & (said["n"] < opens["at"] + opens["size"]), "left").drop(said["session"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "content"))), lambda x: F.concat(x["content"], F.lit("\n"))), "")
    return j.groupBy("session", "slot", "line").agg(cut_bytes(text, 1000).alias("section"))


def code_changes(calls: DataFrame) -> DataFrame:
    """(session, file, first_line, lines, kinds): edits (session, line, file, kind) grouped by file."""
    return calls.groupBy("session", "file").agg(F.min("line").alias("first_line"), F.array_sort(F.collect_set("line")).alias("lines"), F.array_sort(F.collect_set("kind")).alias("kinds"))


def unfinished_score(counts: DataFrame) -> DataFrame:
    """Adds score, 0 to 1, to a row of counts a session: open_blockers, open_changes, urgent_handoffs, unconfirmed, hard,
    has_state, has_next, state_blockers, has_verification, story_slots (null: no story)."""
    capped = lambda c, each, most: F.least(F.col(c) * each, F.lit(most))
    state = F.when(~F.col("has_state"), 0.1).otherwise(F.when(F.col("has_next"), 0.1).otherwise(0.0) + F.when(F.col("state_blockers") > 0, 0.1).otherwise(0.0) + F.when(F.col("has_verification"), 0.05).otherwise(0.0))
    story = F.when(F.col("story_slots").isNull(), 0.1).otherwise(F.least((4 - F.col("story_slots")) * 0.05, F.lit(0.2)))
    total = capped("open_blockers", 0.15, 0.5) + capped("open_changes", 0.1, 0.3) + capped("urgent_handoffs", 0.1, 0.2) + capped("unconfirmed", 0.05, 0.2) + capped("hard", 0.05, 0.1) + state + story
    return counts.withColumn("score", F.least(total, F.lit(1.0)))


def handoff_priority(top: Column, severe_blocker: Column, open_fix: Column, hard_compliance: Column, redesign: Column) -> Column:
    """How urgent a handoff is: the largest of what applies."""
    rule = lambda c, v: F.when(c, v).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.coalesce(top, F.lit(0.0)), rule(severe_blocker, 0.85), rule(open_fix, 0.8), rule(hard_compliance, 0.9), rule(redesign, 0.9)))


def knowledge_id(kind: str, session: Column, text: Column) -> Column:
    """A fact's id: the same words in the same session are the same fact."""
    return F.concat_ws(":", F.lit(f"knowledge:{kind}"), session, F.substring(F.sha2(text.cast("binary"), 256), 1, 16))


def last_intent(units: DataFrame) -> DataFrame:
    """(session, line, intent): the user's last words, cut at 500 bytes."""
    return units.where("role = 'user'").groupBy("session").agg(F.max_by(F.struct("line", "content"), "line").alias("t")).select("session", "t.line", cut_bytes(F.col("t.content"), 500).alias("intent"))


def code_state_diff(units: DataFrame, last: int = 50) -> DataFrame:
    """(session, diff): of each session's last units (session, line, output, success) the successful outputs that show a diff or a patch,
    newest first, each cut at 300 bytes. Sessions without one have no row."""
    back = Window.partitionBy("session").orderBy(F.desc("line"))
    recent = units.withColumn("back", F.row_number().over(back)).where(F.col("back") <= last)
    shown = recent.where("success and (contains(output, 'diff') or contains(output, 'patch'))")
    listed = F.array_sort(F.collect_list(F.struct("back", cut_bytes(F.col("output"), 300).alias("text"))))
    return shown.groupBy("session").agg(F.array_join(F.transform(listed, lambda x: x["text"]), " | ").alias("diff"))
