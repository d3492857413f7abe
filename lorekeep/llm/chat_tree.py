"""Chat formatting as a prefix tree: turns that conversations share are emitted once, depth first."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, dealt_anew, table

#: Control strings of the template, escaped inside texts.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_BREAK = re.compile(r"<(?=/?s>|</?SYS>>)|\[(?=/?INST\])")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_SAYS = {"\\": "\\", "e": "", "n": "\n"}


def escape(text: str) -> str:
    r"""Backslashes are doubled and each control string gets `\e` after its first character; nothing else changes."""
    return _BREAK.sub(lambda m: m[0] + "\\e", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _SAYS[m[1]], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as the template writes it, and the part under the loss mask (empty but for the assistant)."""
    said = escape(text)
    if role == "user":
        return f"<s>[INST] {said} [/INST]", 0, 0
    if role == "assistant":
        return f" {said} </s>", 1, 1 + len(said)
    name = escape(role).replace("\n", "\\n")
    return f"<<SYS>>{name}\n{said}<</SYS>>", 0, 0


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        if formatted.startswith("<s>[INST] ", at):
            end = formatted.index(" [/INST]", at + 10)
            out.append(("user", unescape(formatted[at + 10 : end])))
            at = end + 8
        elif formatted.startswith("<<SYS>>", at):
            end = formatted.index("<</SYS>>", at + 7)
            role, _, text = formatted[at + 7 : end].partition("\n")
            out.append((unescape(role), unescape(text)))
            at = end + 8
        else:
            end = formatted.index(" </s>", at + 1)
            out.append(("assistant", unescape(formatted[at + 1 : end])))
            at = end + 5
    return out


def _walked(rows: DataFrame, order: tuple[str, ...], step: Callable[[], Callable[[tuple], list[tuple]]], schema: str) -> DataFrame:
    """Rows of a conversation come to one task in order, and step() sees them one at a time; nothing is held but its state.

    The first column is conv_id. step() is made anew for each conversation; called with None it has seen the last row.
    """
    target = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        now, see, out = (), None, []

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[] for _ in arrow]
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)
            out.clear()
            return made

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (row[0],):
                    if see is not None:
                        out += see(None)
                    now, see = (row[0],), step()
                out += see(row)
            if out:
                yield emit()
        if see is not None:
            out += see(None)
        if out:
            yield emit()

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(run, target)


def _steps(conversations: DataFrame) -> DataFrame:
    """A row a turn: conv_id, i, the node (the hash of all turns so far), its parent and the formatted piece."""
    said = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def step() -> Callable[[tuple | None], list[tuple]]:
        parent, i = b"", 0

        def see(row: tuple | None) -> list[tuple]:
            nonlocal parent, i
            if row is None:
                return []
            conv, _, role, text = row
            name, data = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
            node = xxhash.xxh3_128_digest(parent + len(name).to_bytes(8, "big") + name + data)
            out = (conv, i, node, parent, role, *render(role, text))
            parent, i = node, i + 1
            return [out]

        return see

    return _walked(said, ("turn", "role", "text"), step, "conv_id long, i int, node binary, parent binary, role string, piece string, loss_start int, loss_end int")


def prefix_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stream, walks).

    stream has a row for each distinct prefix of turns, in depth-first order: node, parent, role, piece (its
    characters, the tokens here), start and end (its place in the one stream of all trees), position (the id of its
    first token: the length of all ancestors), loss_start and loss_end (inside piece), attention (the intervals of
    the stream that its tokens attend to besides themselves: its ancestors, touching ones merged), conversations (how
    many walk through). walks has conv_id, i and node, the steps from the root on.

    Turns of equal number go by role, then text. A null text or role is empty; rows without conv_id are one
    conversation; an empty table gives an empty stream.

    Nodes are summed map-side, so a first turn that a third of all conversations share is one row a task, and the
    joins back to it are split by Spark. A conversation is read as a sorted stream, never collected. The depth-first
    key of a node is the way through the places where conversations part, not through every turn, so a long
    conversation has short keys. Offsets are sums within range partitions plus one base for each, so no tree is
    held by one task.
    """
    steps = cut(_steps(conversations))
    walks = steps.select("conv_id", "i", "node")
    firsts = [F.first(c).alias(c) for c in ("parent", "role", "piece", "loss_start", "loss_end")]
    nodes = cut(steps.groupBy("node").agg(*firsts, F.count("*").alias("conversations"), F.min("conv_id").alias("owner")))
    known = nodes.select(dealt_anew(F.col("node")).alias("node"), F.length("piece").alias("size"), "conversations", "owner")

    def key_step() -> Callable[[tuple | None], list[tuple]]:
        path, through, at = b"", None, 0

        def see(row: tuple | None) -> list[tuple]:
            nonlocal path, through, at
            if row is None:
                return []
            conv, i, node, size, many, owner = row
            if many != through:  # some part here: a new branch begins
                path, through = path + b"\x01" + node[:8], many
            out = [(node, path + b"\x00" + i.to_bytes(4, "big"), at, size)] if conv == owner else []
            at += size
            return out

        return see

    keyed = _walked(walks.join(known, "node").select("conv_id", "i", "node", "size", "conversations", "owner"), ("i",), key_step, "node binary, key binary, position long, size int")
    n = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = cut(cut(keyed).repartitionByRange(n, "key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id()))
    base, total = {}, 0
    for row in sorted(ordered.groupBy("part").agg(F.sum("size").alias("n")).collect(), key=lambda r: r["part"]):  # a number for each partition
        base[row["part"]], total = total, total + row["n"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None
        for batch in batches:
            if not batch.num_rows:
                continue
            here = base[batch.column(1)[0].as_py()] if here is None else here
            sizes = np.array(batch.column(2), dtype=np.int64)
            ends = here + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - sizes), pa.array(ends), batch.column(3)], names=["node", "start", "end", "position"])
            here = int(ends[-1])

    placed = cut(ordered.select("node", "part", "size", "position").mapInArrow(place, "node binary, start long, end long, position long"))

    def attention_step() -> Callable[[tuple | None], list[tuple]]:
        spans: list[dict[str, int]] = []

        def see(row: tuple | None) -> list[tuple]:
            if row is None:
                return []
            conv, _, node, start, end, owner = row
            out = [(node, [dict(s) for s in spans])] if conv == owner else []
            if spans and spans[-1]["end"] == start:
                spans[-1]["end"] = end
            else:
                spans.append({"start": start, "end": end})
            return out

        return see

    spans = walks.join(placed.select("node", "start", "end"), "node").join(known.select("node", "owner"), "node").select("conv_id", "i", "node", "start", "end", "owner")
    attention = _walked(spans, ("i",), attention_step, "node binary, attention array<struct<start:bigint,end:bigint>>")
    return nodes.drop("owner").join(placed, "node").join(attention, "node"), walks


def read_back(stream: DataFrame, walks: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, positions_ok, from the emitted stream.

    A conversation is its nodes' pieces by position id; positions_ok says that they touch and that each attends to just
    as many tokens as stand before it.
    """
    pieces = stream.select("node", "position", "piece", "loss_start", "loss_end", F.expr("aggregate(attention, 0L, (a, x) -> a + x.end - x.start)").alias("seen"))

    def step() -> Callable[[tuple | None], list[tuple]]:
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n, lost, at, ok, conv = 0, 0, 0, True, None

        def see(row: tuple | None) -> list[tuple]:
            nonlocal n, lost, at, ok, conv
            if row is None:
                return [(conv, n, turns.hexdigest(), lost, loss.hexdigest(), at, ok)]
            conv, _, position, piece, lo, hi, seen = row
            for role, text in parse(piece):
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                n += 1
            said = unescape(piece[lo:hi])
            loss.update(said.encode("utf-8", "surrogatepass"))
            lost += len(said)
            ok = ok and position == at == seen
            at += len(piece)
            return []

        return see

    rows = walks.join(pieces, "node").select("conv_id", "i", "position", "piece", "loss_start", "loss_end", "seen")
    return _walked(rows, ("i",), step, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, positions_ok boolean")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and number -7, whose texts hold the template's own control strings."""
    text = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(probe)


def op4_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(*prefix_tree(with_probe(table(spark, sf_dir, "conversations"))))
