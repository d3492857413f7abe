"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt_anew


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(dealt_anew(F.col("u")).alias("u"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.withColumn("u", dealt_anew(F.col("u"))), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b), of any comparable type.

    Self-loops and repeated edges change nothing; rows with a null end are left out; no edges give no rows. A hub's
    minimum is found by a pre-aggregated min, its edges meet it in a join whose hot keys Spark splits. Each round is
    written to the checkpoint folder, and the rounds grow with the logarithm of a component's size.
    """
    now = cut(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct())
    mark = lambda e: e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    seen = mark(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        now = cut(_small_star(_large_star(now)).distinct())
        was, seen = seen, mark(now)
        if seen == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
