"""The append-only journal: reading, quarantine, validation and appending.

A journal is a DataFrame of seq, id, observed_utc, op and payload (JSON text). Order is meaning, so seq is stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import VERSION, event_id
from ..functions.text import STAMP
from .files import file_lines

SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("id", T.StringType()), T.StructField("observed_utc", T.StringType()),
    T.StructField("op", T.StringType()), T.StructField("payload", T.StringType()),
])
OPS = ("node.upsert", "edge.assert", "edge.retract", "config.set")
#: String fields that each operation needs.
NEEDS = {"node.upsert": ("id",), "edge.assert": ("from", "to", "type"), "edge.retract": ("from", "to", "type"), "config.set": ("key",)}


def _is_string(json: Column, path: str) -> Column:
    """Whether a JSON text holds a string at the path."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), path, "variant")) == "STRING", F.lit(False))


def keeps_line(line: Column) -> Column:
    """A line that is a JSON object with a string id and a string op; any other is quarantined."""
    return line.rlike(r"\A\s*\{") & _is_string(line, "$.id") & _is_string(line, "$.op")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line) of a JSONL file or folder; seq grows with file and place. Files of any size are split as Spark splits them."""
    lines = file_lines(spark, path).where("trim(value) <> ''").select("file", (F.col("line") - 1).alias("place"), F.col("value").alias("line"))
    named = lines.select("file").distinct().select("file", F.dense_rank().over(_by_file()).alias("rank"))  # one row a segment
    return lines.join(F.broadcast(named), "file").select((F.col("rank") * F.lit(2**32) + F.col("place")).alias("seq"), "line")


def _by_file():
    from pyspark.sql import Window

    return Window.orderBy("file")


def split_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(journal, quarantine): valid lines as events, the rest byte for byte."""
    flagged = lines.withColumn("keep", keeps_line(F.col("line")))
    field = lambda name: F.get_json_object("line", f"$.{name}")
    journal = flagged.where("keep").select("seq", field("id").alias("id"), field("observed_utc").alias("observed_utc"), field("op").alias("op"), field("payload").alias("payload"))
    return journal, flagged.where("not keep").select("seq", "line")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """All valid events; lines that can't be read are skipped."""
    return split_lines(read_lines(spark, path))[0]


def read_strict(spark: SparkSession, path: str) -> DataFrame:
    """All events; the first line that can't be read is an error that names it."""
    journal, bad = split_lines(read_lines(spark, path))
    if (first := bad.orderBy("seq").first()) is not None:
        raise ValueError(f"line {first['seq'] % 2**32 + 1}: not an event")
    return journal


def shape_error(op: Column, payload: Column) -> Column:
    """Why an event can't be appended, null if it can."""
    error = F.when(~op.isin(*OPS) | op.isNull(), F.concat(F.lit("unknown op: "), F.coalesce(op, F.lit("null"))))
    error = error.when(~F.coalesce(payload.rlike(r"\A\s*\{") & F.try_parse_json(payload).isNotNull(), F.lit(False)), F.concat(op, F.lit(": payload must be a JSON object")))
    for name, keys in NEEDS.items():
        for key in keys:
            error = error.when((op == name) & ~_is_string(payload, f"$.{key}"), F.lit(f"{name}: requires string field `{key}`"))
    return error


def prepare(events: DataFrame, last_seq: int = -1, version: str = VERSION) -> tuple[DataFrame, DataFrame]:
    """(journal rows, rejects) of proposed events (place, op, payload, observed_utc or null), numbered after last_seq by place.

    place is any increasing integer; seq is last_seq + 1 + place, so numbering needs no single task.
    """
    checked = events.withColumn("error", shape_error(F.col("op"), F.col("payload")))
    now = F.date_format(F.current_timestamp(), STAMP)
    good = checked.where("error is null").select(
        (F.lit(last_seq + 1) + F.col("place")).cast("long").alias("seq"), event_id(F.col("op"), F.col("payload"), version).alias("id"),
        F.coalesce("observed_utc", now).alias("observed_utc"), "op", "payload",
    )
    return good, checked.where("error is not null").select("place", "op", "payload", "error")


def append(journal_path: str, events: DataFrame, version: str = VERSION) -> DataFrame:
    """Append valid events to a Parquet journal and return the rejects."""
    spark = events.sparkSession
    try:
        last = spark.read.schema(SCHEMA).parquet(journal_path).agg(F.max("seq")).first()[0]
    except Exception as e:  # noqa: BLE001 - a journal that isn't there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = None
    good, bad = prepare(events, -1 if last is None else last, version)
    good.write.mode("append").parquet(journal_path)
    return bad
