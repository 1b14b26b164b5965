"""Spanning forests, tours around them, and the edges whose loss cuts a network: all in rounds, no part of the graph in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.plans.stages import stash

from .chains import chains, running
from .components import components

#: Into so many parts the edges at a node are dealt when they are put in a circle.
PARTS = 64


def spanning_forest(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(id): edges of ``edges`` (id, u, v) that join every component without a ring.

    Every part takes its edge of least id to another part, and parts that are joined become one, until none has such an edge.
    """
    now = stash(edges.where("u <> v").select("id", "u", "v"), "parts")
    taken = None
    for _ in range(most_rounds):
        each = now.select("id", F.explode(F.array("u", "v")).alias("part")).groupBy("part").agg(F.min("id").alias("id"))
        chosen = stash(each.select("id").distinct(), "chosen")
        if chosen.isEmpty():
            return chosen if taken is None else taken
        taken = chosen if taken is None else taken.unionByName(chosen)
        part = stash(components(now.join(chosen, "id", "left_semi"), "u", "v"), "part")
        for end in ("u", "v"):
            now = now.join(part.withColumnsRenamed({"node": end, "component": f"_{end}"}), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
        now = stash(now.where("u <> v"), "parts")
    raise RuntimeError(f"parts weren't joined in {most_rounds} rounds")


def tour(tree: DataFrame, *, root: Column | None = None) -> DataFrame:
    """(id, a, b, back, chain, pos): both directions of the edges of a forest ``tree`` (u, v), in the order of a walk around each of its trees.

    ``back`` is the id of the other direction. After an edge into a node comes the next one out of it in a circle around the node, so the walk passes each edge
    once down and once up. A walk begins with the edge of least id, whose ``a`` is the tree's root: a node for which ``root`` (over ``a``) holds, if there is one.
    """
    both = stash(tree.select("u", "v").withColumn("k", F.monotonically_increasing_id()), "tree")
    arcs = both.select((F.col("k") * 2).alias("id"), F.col("u").alias("a"), F.col("v").alias("b"), (F.col("k") * 2 + 1).alias("back")).unionByName(
        both.select((F.col("k") * 2 + 1).alias("id"), F.col("v").alias("a"), F.col("u").alias("b"), (F.col("k") * 2).alias("back"))
    )
    if root is not None:
        late = F.lit(1 << 61)
        top = lambda end: F.when(root if end == "a" else F.col("_top"), F.lit(0)).otherwise(late)
        other = arcs.select(F.col("id").alias("back"), root.alias("_top"))
        arcs = arcs.join(other, "back").select((F.col("id") + top("a")).alias("id"), "a", "b", (F.col("back") + top("b")).alias("back"))
    dealt = stash(arcs.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(PARTS))), "arcs")
    around = Window.partitionBy("a").orderBy("_part")  # PARTS rows a node at most
    first = dealt.groupBy("a", "_part").agg(F.min("id").alias("_first"))
    first = first.select("a", "_part", F.coalesce(F.lead("_first").over(around), F.first("_first").over(around)).alias("_onward"))
    within = dealt.select("a", "_part", "id", F.lead("id").over(Window.partitionBy("a", "_part").orderBy("id")).alias("_next"))
    after = within.join(first, ["a", "_part"]).select(F.col("id").alias("back"), F.coalesce("_next", "_onward").alias("to"))
    placed = chains(dealt.join(after, "back").select(F.col("id").alias("node"), "to"))
    return stash(dealt.drop("_part").join(placed.select(F.col("node").alias("id"), "chain", "pos"), "id"), "tour")


def bridges(edges: DataFrame, weights: DataFrame, *, root: object, u: str = "u", v: str = "v") -> DataFrame:
    """(u, v, beyond): edges whose loss cuts their component, with the weight on the side away from the root (the least node where the root isn't).

    Every edge outside a spanning forest gets 64 bits from a hash of its ends, and a node the exclusive or of its edges' bits. Below a tree edge these come to
    zero just if no other edge leads out from there (but for a chance of 2**-64 an edge). What lies below is a stretch of the tour, so sums
    over it are differences of running sums. Parallel edges are no bridges; ``weights`` is (node, weight), and a node without a row weighs 0.
    """
    pairs = edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).where("u <> v").groupBy("u", "v").agg(F.count("*").alias("n"))
    pairs = stash(pairs.withColumn("id", F.monotonically_increasing_id()), "pairs")
    forest = stash(spanning_forest(pairs), "forest")
    walk = tour(pairs.join(forest, "id", "left_semi"))
    rest = pairs.join(forest, "id", "left_anti").unionByName(pairs.where("n > 1"))
    bits = rest.select(F.xxhash64("u", "v").alias("bits"), F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.bit_xor("bits").alias("bits"))
    w = weights.groupBy("node").agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    turn = walk.select(F.col("id").alias("back"), F.col("pos").alias("up"))
    down = stash(walk.join(turn, "back").where("pos < up").select("id", "back", "a", "b", "chain", "pos", "up"), "down")
    valued = down.select("id", F.col("b").alias("node")).join(bits, "node", "left").join(w, "node", "left")
    steps = walk.join(valued, "id", "left").select("id", "chain", "pos", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    steps = stash(steps, "steps")
    sums = stash(running(steps, ["chain", "pos"], sums=("weight",), xors=("bits",)), "sums")
    into = sums.select("id", F.col("bits").alias("bits0"), F.col("weight").alias("weight0")).join(steps.select("id", F.col("bits").alias("own"), F.col("weight").alias("own_weight")), "id")
    out = sums.select(F.col("id").alias("back"), F.col("bits").alias("bits1"), F.col("weight").alias("weight1"))
    below = down.join(into, "id").join(out, "back")
    below = below.select("chain", "a", "b", "pos", "up", F.col("bits1").bitwiseXOR(F.col("bits0")).bitwiseXOR(F.col("own")).alias("bits"), (F.col("weight1") - F.col("weight0") + F.col("own_weight")).alias("below"))
    cut = below.where("bits = 0").join(pairs.where("n > 1").select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(pairs.where("n > 1").select(F.col("v").alias("a"), F.col("u").alias("b"))), ["a", "b"], "left_anti")
    node = walk.select("chain", F.col("a").alias("node")).distinct()
    top = node.join(w, "node", "left").groupBy("chain").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("whole"), F.coalesce(F.max(F.when(F.col("node") == F.lit(root), F.col("node"))), F.min("node")).alias("root"))
    at = top.join(down.select("chain", F.col("b").alias("root"), F.col("pos").alias("at")), ["chain", "root"], "left").select("chain", "whole", "at")
    inside = F.coalesce(F.col("at").between(F.col("pos"), F.col("up")), F.lit(False))
    return cut.join(at, "chain").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.when(inside, F.col("whole") - F.col("below")).otherwise(F.col("below")).alias("beyond"))
