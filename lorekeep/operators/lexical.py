"""Postings, BM25, rank fusion and term weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_single_cjk, once, tokens
from .lineage import settle, small_side

K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, term, tf, len): each document's terms, how often it holds them, and its number of tokens."""
    listed = docs.select(F.col(id_col).alias("id"), once(tokens(text)).alias("t")).select("id", F.size("t").alias("len"), F.explode("t").alias("term"))
    return listed.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def search(docs: DataFrame, id_col: str, text: Column, queries: DataFrame) -> DataFrame:
    """bm25() of documents for queries (query, term): their terms are dropped but for the queries' before anything is grouped.

    Statistics cover all documents. The texts are cut into terms twice, once for the mean length, and never settled.
    """
    wanted = settle(queries.select("query", "term").distinct())
    terms = wanted.select("term").distinct()
    listed = docs.select(F.col(id_col).alias("id"), once(tokens(text)).alias("t")).select("id", F.size("t").alias("len"), F.explode("t").alias("term"))
    held = listed.join(small_side(terms, wanted.count()), "term", "left_semi").groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    return bm25(held, lengths(docs, id_col, text), wanted)


def lengths(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """One row: the number of documents, empty ones too, and their mean number of tokens, 1 at least."""
    return docs.select(F.size(tokens(text)).alias("len")).agg(F.count("*").alias("n"), F.greatest(F.avg("len"), F.lit(1.0)).alias("mean"))


def bm25(post: DataFrame, stats: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id, score) of every document that shares a term with a query (query, term); repeated terms count once.

    A term's postings meet the queries that hold it in one equality join; documents frequencies are summed map-side.
    """
    wanted = queries.select("query", "term").distinct()
    held = post.join(wanted.select("term").distinct(), "term", "left_semi")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    # stats is one row
    weighed = held.join(df, "term").crossJoin(F.broadcast(stats)).select(
        "id", "term",
        (F.when(is_single_cjk(F.col("term")), 0.2).otherwise(1.0) * F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
         * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))).alias("part"),
    )
    return weighed.join(wanted, "term").groupBy("query", "id").agg(F.sum("part").alias("score")).where("score > 0")


def top(scored: DataFrame, k: int, by: str = "query") -> DataFrame:
    """The k best of each query, ties to the smaller id, with their rank and score over the query's best."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.withColumn("norm", F.col("score") / F.max("score").over(Window.partitionBy(by)))


def fuse(ranked: DataFrame) -> DataFrame:
    """(query, id, score) by reciprocal ranks: 1 / (60 + source rank from 1) + 1 / (61 + local rank from 0)."""
    return ranked.select("query", "id", (1 / (60.0 + F.col("source_rank")) + 1 / (61.0 + F.col("local_rank"))).alias("score"))


def term_weights(nodes: DataFrame, terms: DataFrame, text: str = "identity") -> DataFrame:
    """(term, weight): ln((N + 1) / (df + 1)) + 1, df being the nodes whose text holds the term anywhere, in any case.

    terms is a stated request's handful of words; it is sent to the nodes and the counts come back summed.
    """
    n = nodes.agg(F.count("*").alias("n"))
    hit = nodes.select(F.lower(text).alias("hay")).join(F.broadcast(terms.select("term").distinct()), F.col("hay").contains(F.lower("term")))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    return terms.select("term").distinct().join(df, "term", "left").crossJoin(F.broadcast(n)).select("term", (F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("weight"))


def term_coverage(nodes: DataFrame, terms: DataFrame, limit: int = 10, text: str = "identity") -> DataFrame:
    """(id, score, why) of the nodes that hold any term, by the share of the request's weight that they cover."""
    w = term_weights(nodes, terms, text)
    total = w.agg(F.sum("weight").alias("total"), F.count("*").alias("of"))
    hits = nodes.select("id", F.lower(text).alias("hay")).join(F.broadcast(w), F.col("hay").contains(F.lower("term")))
    scored = hits.groupBy("id").agg(F.sum("weight").alias("w"), F.count("*").alias("k")).crossJoin(F.broadcast(total))
    out = scored.select("id", (F.col("w") / F.col("total")).alias("score"), F.format_string("term_coverage:%d/%d", "k", "of").alias("why"))
    return out.orderBy(F.desc("score"), "id").limit(limit)
