"""Files and databases around a knowledge base: SQLite tables, inboxes, trees of files, wiki pages."""

from __future__ import annotations

import hashlib
import sqlite3
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.text import credential_kind


class _Rows(InputPartition):
    def __init__(self, lo: int | None, hi: int | None):
        self.lo, self.hi = lo, hi


class _SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = [f.name for f in schema.fields]
        self.path, self.table, self.parts = options["path"], options["dbtable"], int(options.get("numPartitions", "1"))

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        """Ranges of rowid, so that a large table is read by many tasks."""
        with self._open() as db:
            lo, hi = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if lo is None or self.parts == 1:
            return [_Rows(lo, hi)]
        step = -(-(hi - lo + 1) // self.parts)
        return [_Rows(a, min(hi, a + step - 1)) for a in range(lo, hi + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.lo is None:
            return
        columns = ", ".join(f'"{n}"' for n in self.names)
        with self._open() as db:
            yield from db.execute(f'SELECT {columns} FROM "{self.table}" WHERE rowid BETWEEN ? AND ? ORDER BY rowid', (partition.lo, partition.hi))


class Sqlite(DataSource):
    """A table of a SQLite file that all machines can open: spark.read.format("sqlite").schema(...).option("dbtable", ...).load(path)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(schema, self.options)


def read_sqlite(spark: SparkSession, path: str, dbtable: str, schema: str, parts: int = 1) -> DataFrame:
    spark.dataSource.register(Sqlite)
    return spark.read.format("sqlite").schema(schema).option("dbtable", dbtable).option("numPartitions", parts).load(path)


def inbox(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(name, text, sha256, credential): text files below path; credential names what kind of secret forbids to take one in."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    text = F.col("content").cast("string")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), text.alias("text"), F.sha2("content", 256).alias("sha256"), credential_kind(text).alias("credential"))


def inbox_events(files: DataFrame) -> DataFrame:
    """(name, op, payload): an upsert for each clean file; its id is the hash of its content."""
    title = F.trim(F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1))
    payload = F.to_json(F.struct(
        F.concat(F.lit("inbox:"), F.substring("sha256", 1, 16)).alias("id"), F.lit("Source").alias("type"), F.when(title != "", title).otherwise(F.col("name")).alias("label"),
        F.col("text").alias("body"), F.col("name").alias("path"), F.col("sha256").alias("content_sha256"), F.lit("inbox").alias("provenance"),
    ))
    return files.where("credential is null").select("name", F.lit("node.upsert").alias("op"), payload.alias("payload"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def tree_hash(files: DataFrame) -> Column:
    """Aggregate: one hash of a folder's names and hashes, whatever the order they are read in."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\u0000", "path", "sha256"))), "\n").cast("binary"), 256)


def bundle_hash(files: list[tuple[str, bytes]]) -> str:
    """SHA-256 over name, NUL and bytes of files sorted by name."""
    out = hashlib.sha256()
    for name, data in sorted(files):
        out.update(name.encode() + b"\0" + data)
    return out.hexdigest()


def wiki_pages(files: DataFrame) -> DataFrame:
    """(name, title, tags, sources, related, node_id, body, problem) of Markdown files (name, text) with a front matter of plain keys and lists."""
    pattern = r"(?s)\A\x{FEFF}?---\r?\n(.*?)\r?\n---\r?\n?(.*)\z"
    head = F.regexp_extract("text", pattern, 1)
    one = lambda key: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{key}:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1)), F.lit(""))

    def many(key: str) -> Column:
        inline = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*\[(.*?)\][ \t]*$", 1)
        block = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*((?:\r?\n[ \t]*- .*)*)", 1)
        strip = lambda x: F.regexp_replace(F.trim(x), "\\A[\"']|[\"']\\z", "")
        listed = F.when(inline != "", F.transform(F.split(inline, ","), strip)).otherwise(F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*- (.*)$"), F.lit(1)), strip))
        return F.filter(listed, lambda x: x != "")

    rows = files.select("name", one("title").alias("title"), many("tags").alias("tags"), many("sources").alias("sources"), many("related").alias("related"), one("node_id").alias("node_id"), F.regexp_extract("text", pattern, 2).alias("body"), head.alias("head"))
    lacking = [F.when(~F.col("head").rlike(rf"(?m)^{k}:"), F.lit(k)) for k in ("title", "tags", "sources", "related")]
    problem = F.when(F.col("head") == "", "no front matter").when(F.size(F.array_compact(F.array(*lacking))) > 0, F.concat(F.lit("missing "), F.array_join(F.array_compact(F.array(*lacking)), ", ")))
    return rows.withColumn("problem", problem).drop("head")


def resolve_references(references: DataFrame, pages: DataFrame) -> DataFrame:
    """(name, key, target): wiki references (name, key) by path, else by a file name that is unique; null target: broken."""
    paths = pages.select(F.regexp_replace("name", r"\.md\z", "").alias("key"), F.col("name").alias("by_path"))
    base = pages.select(F.regexp_replace(F.element_at(F.split("name", "/"), -1), r"\.md\z", "").alias("key"), "name").groupBy("key").agg(F.when(F.count("*") == 1, F.first("name")).alias("by_name"))
    return references.join(paths, "key", "left").join(base, "key", "left").select(references["name"], "key", F.coalesce("by_path", "by_name").alias("target"))


def sync_events(desired: DataFrame, live: DataFrame) -> DataFrame:
    """(op, payload) that turn live managed edges (from, type, to) into the desired ones; equal ones cause nothing."""
    keys = ["from", "type", "to"]
    event = lambda df, op: df.select(F.lit(op).alias("op"), F.to_json(F.struct(*keys)).alias("payload"))
    d, l = desired.select(*keys).distinct(), live.select(*keys).distinct()
    return event(d.join(l, keys, "left_anti"), "edge.assert").union(event(l.join(d, keys, "left_anti"), "edge.retract"))


def changed_fields(desired: DataFrame, live: DataFrame) -> DataFrame:
    """(id, changed): fields of desired nodes (id, attrs) that the live ones lack or hold otherwise; nodes without any are left out."""
    j = desired.join(live.select("id", F.col("attrs").alias("now")), "id", "left")
    have = F.coalesce("now", F.expr("cast(map() as map<string,string>)"))
    return j.select("id", F.map_filter("attrs", lambda k, v: ~F.try_element_at(have, k).eqNullSafe(v)).alias("changed")).where("size(changed) > 0")
