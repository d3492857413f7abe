"""Numbered lines of text files of any size, and which files may be read as sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Endings of files that may be cited as text sources; files without an ending may too.
TEXT_ENDINGS = ("md", "txt", "json", "jsonl", "yaml", "yml", "log")


def file_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(file, line, value) of the text files below path; line counts from 1, empty lines too.

    Files are split as Spark splits them. Lines are numbered within their split, and a split's first number is the sum
    of the splits before it: one row a split is all that is gathered of a file.
    """
    read = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    if pattern is not None:
        read = read.option("pathGlobFilter", pattern)
    rows = read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value")
    split = Window.partitionBy("file", "start")
    numbered = rows.withColumn("n", F.row_number().over(split.orderBy("id")))
    sizes = rows.groupBy("file", "start").agg(F.count("*").alias("size"))
    before = sizes.select("file", "start", F.coalesce(F.sum("size").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return numbered.join(before, ["file", "start"]).select("file", (F.col("before") + F.col("n")).alias("line"), "value")


def capped(lines: DataFrame, most_bytes: int = 512 * 1024) -> DataFrame:
    """Lines (..., value) with oversized set, and value null, where a line has more bytes than allowed; bytes says how many."""
    size = F.octet_length("value")
    return lines.withColumns({"bytes": size, "oversized": size > most_bytes, "value": F.when(size <= most_bytes, F.col("value"))})


def source_type_error(path: Column) -> Column:
    """Why a file can't be read as a text source, null if it can."""
    name = F.element_at(F.split(path, "/"), -1)
    ending = F.lower(F.regexp_extract(name, r"(?s)\A.+\.([^.]*)\z", 1))
    return F.when(~ending.isin("", *TEXT_ENDINGS), F.concat(F.lit("unsupported source type ."), ending))
