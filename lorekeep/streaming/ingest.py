"""Continuous ingestion: files that arrive become events, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.canonical import event_id
from ..functions.text import STAMP, credential_kind
from ..operators.lineage import settle
from ..sources.journal import OPS, shape_error
from ..sources.stores import inbox_events


def inbox_stream(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """New text files of a folder as (name, text, sha256, credential)."""
    files = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", pattern).load(path)
    text = F.col("content").cast("string")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), text.alias("text"), F.sha2("content", 256).alias("sha256"), credential_kind(text).alias("credential"))


def _append(journal: str):
    def write(events: DataFrame, batch: int) -> None:
        """A batch goes to a folder of its own, so that a repeated batch replaces itself: each event is there once."""
        ordered = settle(events.sort("name", "op", "payload"))
        sizes = {r["part"]: r["count"] for r in ordered.groupBy(F.spark_partition_id().alias("part")).count().collect()}
        before = F.create_map(F.lit(-1), F.lit(0).cast("long"), *(x for p in sizes for x in (F.lit(p), F.lit(sum(sizes[q] for q in sizes if q < p)).cast("long"))))
        place = F.element_at(before, F.spark_partition_id()) + F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
        numbered = ordered.withColumn("seq", F.lit(batch + 1) * F.lit(2**40) + place)  # by name and place in the batch: dense, and the same if the batch is repeated
        rows = numbered.where(shape_error(F.col("op"), F.col("payload")).isNull()).select(
            "seq", event_id(F.col("op"), F.col("payload")).alias("id"), F.date_format(F.current_timestamp(), STAMP).alias("observed_utc"), "op", "payload"
        )
        rows.write.mode("overwrite").parquet(f"{journal}/batch={batch}")

    return write


def ingest(spark: SparkSession, inbox: str, journal: str, checkpoint: str, pattern: str = "*.md") -> StreamingQuery:
    """Take in all files that are there and not yet taken in, then stop. The checkpoint is the cursor of consumed files."""
    events = inbox_events(inbox_stream(spark, inbox, pattern))
    return events.writeStream.foreachBatch(_append(journal)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tail_journal(spark: SparkSession, journal: str) -> DataFrame:
    """A journal of Parquet segments as a stream of events."""
    return spark.readStream.schema("seq long, id string, observed_utc string, op string, payload string").option("recursiveFileLookup", "true").parquet(journal)


def activity(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, op, n) of a stream or table of events; events later than the watermark are left out of a stream's windows."""
    at = F.try_to_timestamp("observed_utc", F.lit(STAMP))
    return events.where(F.col("op").isin(*OPS)).withColumn("at", at).where("at is not null").withWatermark("at", late).groupBy(F.window("at", width), "op").agg(F.count("*").alias("n"))
