"""From words to the passages that answer them: graph candidates, their sources, and passages ranked across sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import centred_excerpt, searchable_text
from ..functions.text import tokens as tokenized
from . import lexical as L
from . import retrieval as R
from .graph import Graph
from .selection import trace as walk

SEEDS, K_SOURCE, K_LOCAL = 12, 60.0, 61.0


def seeds(graph: Graph, q: str, k: int = SEEDS) -> DataFrame:
    """(id, score): the best nodes for the words, by BM25 over the best; a managed source that nothing derives from is left out."""
    field = lambda name: F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))
    used = graph.edges.where("not retracted and edge = 'DERIVED_FROM'").select(F.col("to").alias("id")).distinct().withColumn("used", F.lit(True))
    nodes = graph.nodes.join(used, "id", "left").where((field("managed_by") == "") | (field("type") != "Source") | F.col("used")).select("id", searchable_text(F.col("attrs")).alias("text"))
    return R.text_seeds(nodes, q, k)


def rank_passages(sources: DataFrame, passages: DataFrame, q: str, limit: int = 10) -> DataFrame:
    """(node, line, score, excerpt): passages (node, line, text) of sources (node, source_score), fused by reciprocal ranks.

    A source's place comes from its score, a passage's from BM25 among the passages of its source. Ties go by node and line.
    """
    wanted = passages.sparkSession.createDataFrame([(q,)], "q string").select(F.explode(F.array_distinct(tokenized(F.col("q")))).alias("term"))
    listed = passages.select("node", "line", "text", tokenized(F.col("text")).alias("t"))
    stats = listed.groupBy("node").agg(F.count("*").alias("n"), F.greatest(F.avg(F.size("t")), F.lit(1.0)).alias("mean"))
    tf = listed.select("node", "line", F.size("t").alias("len"), F.explode("t").alias("term")).join(F.broadcast(wanted), "term", "left_semi").groupBy("node", "line", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("node", "term").agg(F.count("*").alias("df"))
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (L.K1 + 1) / (F.col("tf") + L.K1 * (1 - L.B + L.B * F.col("len") / F.col("mean")))
    scored = tf.join(df, ["node", "term"]).join(stats, "node").groupBy("node", "line").agg(F.sum(part).alias("bm25"))
    held = scored.select("node").distinct()
    places = sources.join(held, "node", "left_semi").withColumn("source_rank", F.row_number().over(Window.orderBy(F.desc("source_score"), "node")))  # sources of one request
    local = scored.withColumn("local_rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("bm25"), "line")) - 1)
    fused = local.join(F.broadcast(places), "node").select("node", "line", (1 / (K_SOURCE + F.col("source_rank")) + 1 / (K_LOCAL + F.col("local_rank"))).alias("score"))
    best = fused.orderBy(F.desc("score"), "node", "line").limit(limit)
    terms = [t for t in q.split() if t]
    return best.join(passages, ["node", "line"]).select("node", "line", F.round("score", 9).alias("score"), centred_excerpt(F.col("text"), terms).alias("excerpt")).orderBy(F.desc("score"), "node", "line")


def search(graph: Graph, passages: DataFrame, q: str, depth: int = 3, most: int = 200, limit: int = 10) -> DataFrame:
    """The best passages for the words in the sources that typed steps reach from the best nodes."""
    reached = walk(graph.edges, seeds(graph, q), depth, most).select("node", F.col("score").alias("source_score"))
    return rank_passages(reached, passages.join(F.broadcast(reached.select("node")), "node", "left_semi"), q, limit)


def fair_shares(pending: DataFrame, budget: int) -> DataFrame:
    """(request, source, allowance, charged) for sources (request, source, score, size) read in order of score, then name.

    Each may read an equal share, one byte at least, of what its predecessors left to it and to all that still wait, so that a
    large first source doesn't starve the others. A request's sources are few: its list is folded in one row.
    """
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "source", "size")))
    each = pending.groupBy("request").agg(listed.alias("p"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.expr("cast(array() as array<struct<source:string,allowance:bigint,charged:bigint>>)").alias("out"))

    def step(acc, x):
        waiting = F.size("p") - F.size(acc["out"])
        share = F.least(F.greatest(F.floor(acc["left"] / waiting).cast("long"), F.lit(1).cast("long")), acc["left"])
        charged = F.least(share, x["size"].cast("long"))
        done = F.struct(x["source"].cast("string").alias("source"), share.alias("allowance"), charged.alias("charged"))
        return F.struct((acc["left"] - charged).alias("left"), F.concat(acc["out"], F.array(done)).alias("out"))

    return each.select("request", F.inline(F.aggregate("p", start, step)["out"]))


def metadata_candidates(candidates: DataFrame, references: DataFrame, most_depth: int) -> tuple[DataFrame, DataFrame]:
    """(further, limited): sessions that read sources name, as candidates at nine tenths of the score and one step deeper.

    candidates: node, seed, score, depth, sha256; references: node, source, session, pointer. Candidates as deep as allowed
    aren't followed; limited names them.
    """
    j = candidates.join(references, "node")
    locator = F.to_json(F.struct("source", "session"))
    further = j.where(F.col("depth") < most_depth).select(
        F.concat(F.lit("source-ref:"), F.sha2(locator.cast("binary"), 256)).alias("node"), "seed", (F.col("score") * 0.9).alias("score"), (F.col("depth") + 1).alias("depth"),
        F.col("node").alias("from"), F.concat(F.lit("sha256:"), "sha256", F.lit("#"), "pointer").alias("provenance"),
    )
    return further, j.where(F.col("depth") >= most_depth).select("node").distinct()


def coverage_report(requests: DataFrame) -> DataFrame:
    """(request, incomplete, warnings) from what a search says of itself: wiki_missing, graph_limited, source_limited,
    projection_incomplete, metadata_limited (booleans), remote and unavailable (counts)."""
    said = [
        (F.col("wiki_missing"), F.lit("wiki_projection_missing")), (F.col("graph_limited"), F.lit("graph_node_depth_or_frontier_budget_limited")),
        (F.col("source_limited"), F.lit("source_candidate_budget_limited")),
        (F.col("remote") > 0, F.concat(F.col("remote").cast("string"), F.lit(" remote references not fetched; at most three examples shown"))),
        (F.col("projection_incomplete"), F.lit("source_projection_incomplete")), (F.col("metadata_limited"), F.lit("metadata_source_path_budget_limited")),
    ]
    warnings = F.filter(F.array(*[F.when(c, text) for c, text in said]), lambda w: w.isNotNull())
    return requests.select("request", ((F.size(warnings) > 0) | (F.col("unavailable") > 0)).alias("incomplete"), warnings.alias("warnings"))


def evidence_request(q: str, root: str, as_of: str | None = None, limit: int = 20, offset: int = 0, include_expired: bool = False) -> list[str]:
    """The arguments that ask the same question again with full evidence; defaults are left out."""
    out = ["query", "--root", root, "--q", q, "--view", "evidence"]
    out += (["--as-of", as_of] if as_of is not None else []) + ["--limit", str(limit)] * (limit != 20) + ["--offset", str(offset)] * (offset != 0)
    return out + ["--include-expired"] * include_expired
