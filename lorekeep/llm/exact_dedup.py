"""Exact deduplication by progressive refinement: length, prefix hash, full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, dealt_anew, table, text_of

PREFIX = 96
#: Words of 64 bits in the filter of repeating (length, prefix hash) pairs: all that is broadcast, whatever the corpus holds.
WORDS = 2**20


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """A row for each of docs: row (a struct of all its columns), keep_id, group_size, kept, text_sha256 (null unless digest is set or a copy is likely).

    Texts are equal when they are identical without ASCII white space; a null text is the empty one and all empty
    texts are one group. Of a group the row with the most code points in the original text stays, then the one
    with the smallest id. Every input row comes back once: an id that repeats keeps its rows, all of which count in
    group_size. A null id ranks last. No rows give no rows. Other columns don't matter, whatever their names.

    Level 1 counts lengths and level 2 (length, prefix hash) pairs; both are summed map-side, so a group of any size
    shuffles one row a task. Pairs that repeat set their bit in a filter of bounded size, which is broadcast. Level 3 hashes
    the full text only of rows whose bit is set; only those rows are moved, to meet one row a group in a join whose hot
    keys Spark splits. All other rows stay where they are. A pair that shares another's bit costs a hash, no more.
    """
    signed = (
        docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
        .withColumn("norm", normalised(F.col("text"))).withColumn("raw", F.length("text"))
        .withColumn("len", F.length("norm")).withColumn("pre", F.xxhash64(F.substring("norm", 1, PREFIX)))
    )
    pairs = signed.groupBy("len", "pre").agg(F.count("*").alias("n"))
    lengths = pairs.groupBy("len").agg(F.sum("n").alias("of_len")).where("of_len > 1").select("len")
    key = F.xxhash64("len", "pre")
    word, bit = F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(WORDS - 1)), key.bitwiseAND(F.lit(63)).cast("int")
    repeats = pairs.where("n > 1").join(lengths, "len", "left_semi").select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("mask"))
    bits = cut(repeats.groupBy("word").agg(F.bit_or("mask").alias("mask")))  # WORDS rows at most
    flagged = signed.withColumn("word", word).join(F.broadcast(bits), "word", "left")
    flagged = flagged.withColumn("again", F.coalesce(F.call_function("shiftright", F.col("mask"), bit).bitwiseAND(F.lit(1)) == 1, F.lit(False)))
    sha = F.sha2(F.col("norm"), 256)
    alone = flagged.where("not again").select("row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), (sha if digest else F.lit(None).cast("string")).alias("text_sha256"))
    full = cut(flagged.where("again").select("row", "id", "raw", sha.alias("key")))
    order = F.struct(F.col("raw"), F.col("id").isNotNull(), -F.col("id"))
    groups = full.groupBy("key").agg(F.count("*").alias("size"), F.max_by("id", order).alias("keep")).withColumn("key", dealt_anew(F.col("key")))
    copies = full.join(groups, "key").select("row", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("keep").eqNullSafe(F.col("id")).alias("kept"), F.col("key").alias("text_sha256"))
    return alone.union(copies)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """The rows of docs with what decide() says of them; columns of docs named like an added one are left out."""
    passed = [F.col("row")[c].alias(c) for c in docs.columns if c not in ADDED]
    return decide(docs, id_col, text_col, digest).select(*passed, *(c for c in ADDED if digest or c != "text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with the columns of docs."""
    return decide(docs, id_col, text_col).where("kept").select("row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, digest=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS raw,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY raw DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY raw DESC, doc_id) AS kept,
       text_sha256
FROM n
"""
