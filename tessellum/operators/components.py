"""Connected components of an undirected graph by alternating stars.

Each round links every node's larger neighbours to its least one, then every node's smaller neighbours.
The graph turns into stars around the least node of each component in a number of rounds that grows
with the logarithm of its size. Only two numbers a round come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.plans.stages import spread as stash


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    to_least = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_least.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, src: str = "u", dst: str = "v", most_rounds: int = 60) -> DataFrame:
    """(node, component): for every node with an edge, the least node that it reaches. Nulls and loops are dropped."""
    now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now, mark = stash(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"), None
    for _ in range(most_rounds):
        now = stash(_small_star(_large_star(now)), "stars")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
