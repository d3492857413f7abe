"""Questions to the graph: seeds, hits, neighbours, constraints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip, hit_excerpt, node_kind, searchable_text, split_extension
from . import graph as G
from . import lexical as L
from .lineage import settle

MOST, DEFAULT, TOP, DEPTH = 100, 20, 20, 3


@dataclass(frozen=True)
class Hits:
    """hits (node_id, kind, label, excerpt, score, why) in order, and what to tell about them."""

    hits: DataFrame
    warnings: list[str]


def substring_seeds(nodes: DataFrame, q: str) -> DataFrame:
    """Ids of nodes (id, label) whose id or label holds q as written; an empty q seeds nothing."""
    return nodes.where(F.lit(q != "") & (F.col("id").contains(q) | F.coalesce(F.col("label").contains(q), F.lit(False)))).select("id")


def text_seeds(nodes: DataFrame, q: str, k: int = TOP) -> DataFrame:
    """(id, score): the k best nodes (id, text) for the words of q by BM25, over the best score."""
    wanted = nodes.sparkSession.createDataFrame([(q,)], "q string").select(F.lit(0).alias("query"), F.explode(L.tokens(F.col("q"))).alias("term"))
    scored = L.search(nodes, "id", F.col("text"), wanted).withColumn("score", F.round("score", 9))  # sums in any order tie alike
    best = scored.orderBy(F.desc("score"), "id").limit(k)
    return best.crossJoin(F.broadcast(best.agg(F.max("score").alias("most")))).select("id", (F.col("score") / F.col("most")).alias("score"))


def hits(journal: DataFrame, q: str, as_of: str | None = None, limit: int = DEFAULT, include_expired: bool = False, quarantined: bool = False, words: bool = False) -> Hits:
    """Replay, seeds, forward steps up to three, ranking by depth then id.

    Seeds are the nodes whose id or label holds q and, with words, the best nodes by BM25. A limit beyond 100 is cut
    to 100 and said to be truncated.
    """
    g = G.materialize(journal, as_of, include_expired)
    nodes = settle(g.columns("label", "type", "body", "provenance"))
    seeds = substring_seeds(nodes, q)
    if words and q:
        seeds = seeds.union(text_seeds(g.nodes.select("id", searchable_text(F.col("attrs")).alias("text")), q).select("id")).distinct()
    kept = min(max(limit, 0), MOST)
    ranked = G.walk(nodes, g.edges, seeds, DEPTH).orderBy("depth", "id").limit(kept)
    out = nodes.join(F.broadcast(ranked), "id").select(
        F.col("id").alias("node_id"), node_kind(F.col("type")).alias("kind"), F.coalesce("label", F.lit("")).alias("label"),
        hit_excerpt(F.col("label"), F.col("body")).alias("excerpt"), F.round(1.0 / (1 + F.col("depth")), 6).alias("score"), F.lit("graph").alias("why"),
    ).orderBy(F.desc("score"), "node_id")
    return Hits(out, ["truncated"] * (limit > MOST or limit <= 0) + ["quarantined_skipped"] * quarantined)


def typed_neighbours(edges: DataFrame, kinds: DataFrame, seeds: DataFrame, edge: str, kind: str) -> DataFrame:
    """(seed, id): nodes of a kind that an edge of a type ties to the seeds, in either direction."""
    e = edges.where(~F.col("retracted") & (F.col("edge") == edge)).select("from", "to").distinct()
    both = e.select(F.col("from").alias("seed"), F.col("to").alias("id")).union(e.select("to", "from"))
    return both.join(seeds.select(F.col("id").alias("seed")), "seed", "left_semi").join(kinds.where(F.col("kind") == kind).select("id"), "id", "left_semi").distinct()


def siblings(belongs: DataFrame, labels: DataFrame, seeds: DataFrame, most: int = 12) -> DataFrame:
    """(project, id, label, total): other members of the seeds' projects, the first few by label, and how many there are."""
    mine = belongs.join(seeds, belongs["member"] == seeds["id"], "left_semi").select("project").distinct()
    others = belongs.join(mine, "project", "left_semi").join(seeds.withColumnRenamed("id", "member"), "member", "left_anti").distinct().join(labels, belongs["member"] == labels["id"])
    w = Window.partitionBy("project")
    return others.withColumn("total", F.count("*").over(w)).withColumn("n", F.row_number().over(w.orderBy("label", "member"))).where(F.col("n") <= most).select("project", "id", "label", "total")


def prune_candidates(ranked: DataFrame, shown: DataFrame | None = None, share: float = 0.5, least: int = 3) -> DataFrame:
    """Candidates (query, id, score) not shown yet, of each query those within a share of the best, and the best few anyway."""
    if shown is not None:
        ranked = ranked.join(shown, ["query", "id"], "left_anti")
    w = Window.partitionBy("query")
    placed = ranked.withColumn("n", F.row_number().over(w.orderBy(F.desc("score"), "id"))).withColumn("best", F.max("score").over(w))
    return placed.where((F.col("n") <= least) | (F.col("score") >= share * F.col("best"))).select("query", "id", "score")


def fold_documents(items: DataFrame) -> DataFrame:
    """Items (place, id, kind, label) with the files of one document folded into its first: id, label, also, n.

    Same kind and stem fold; the label lists the endings in order of appearance, with a count where they repeat.
    """
    stem, ext = split_extension(F.col("label"))
    split = items.select("place", "id", "kind", "label", stem.alias("stem"), ext.alias("ext"))
    alone = split.where("ext = ''").select("place", "id", "label", F.expr("cast(array() as array<string>)").alias("also"), F.lit(1).cast("long").alias("n"))
    grouped = split.where("ext <> ''").groupBy("kind", "stem").agg(F.array_sort(F.collect_list(F.struct("place", "id", "label", "ext"))).alias("g"))
    exts, n = F.array_distinct(F.col("g.ext")), F.size("g")
    many = F.when(F.size(exts) > 1, F.concat("stem", F.lit(".{"), F.array_join(exts, ","), F.lit("}"))).otherwise(F.concat(F.col("stem"), F.lit("."), exts[0], F.lit(" ×"), n.cast("string")))
    folded = grouped.select(F.col("g")[0]["place"].alias("place"), F.col("g")[0]["id"].alias("id"), F.when(n == 1, F.col("g")[0]["label"]).otherwise(many).alias("label"), F.slice(F.col("g.id"), 2, n).alias("also"), n.cast("long").alias("n"))
    return alone.union(folded)


def rank_constraints(constraints: DataFrame, terms: DataFrame, most: int = 12) -> DataFrame:
    """Constraints (project, id, text) by the weight of the request's terms (term, weight) that they hold: best few a project, and the total."""
    hit = constraints.join(F.broadcast(terms), F.lower("text").contains(F.lower("term")), "left")
    scored = hit.groupBy("project", "id", "text").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("score"))
    w = Window.partitionBy("project")
    out = scored.withColumn("total", F.count("*").over(w)).withColumn("n", F.row_number().over(w.orderBy(F.desc("score"), "id"))).where(F.col("n") <= most)
    return out.select("project", "id", clip(F.col("text")).alias("label"), "score", "total", "n")


def focus(ranked: DataFrame) -> DataFrame:
    """The candidates of each query that are as good as its best."""
    return ranked.withColumn("best", F.max("score").over(Window.partitionBy("query"))).where(F.col("score") >= F.col("best") - 1e-9).drop("best")


def locator(path: Column, uri: Column, source: Column, session: Column) -> Column:
    """Where a node's source is: a conversation, an address or a file; null without any."""
    made = lambda kind, value, extra: F.struct(F.lit(kind).alias("kind"), value.alias("value"), extra.alias("session"))
    none = F.lit(None).cast("string")
    return F.when(session.isNotNull(), made("conversation", source, session)).when(uri.contains("://"), made("url", uri, none)).when(path.isNotNull(), made("file", path, none))
