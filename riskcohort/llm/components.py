"""Connected components of a distributed edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskcohort.session import cut_lineage


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Every node hands its smallest neighbour to its other neighbours."""
    if larger_only:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    if larger_only:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` of every node of ``edges(u, v)``: the smallest node reachable.

    Each round is checkpointed. Hot nodes are combined before the shuffle, and joins of their many edges can
    be split by the adaptive planner. Fails if the rounds do not suffice (they grow with the logarithm).
    """
    edges = cut_lineage(edges.filter("u != v").select("u", "v").distinct())
    before = None
    for _ in range(max_rounds):
        edges = cut_lineage(_stars(_stars(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
