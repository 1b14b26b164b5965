"""List ranking: what lies along chains of links, for all chains at once, in rounds that grow with the logarithm of the longest.

A link leads from a node to the next one, and a node has one link at most. Every round joins each node's reach with that of the node it
reaches, so reaches double; a chain of any length is spread over all tasks. Rings are opened before their least node.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.plans.stages import ship
from tessellum.plans.stages import spread as stash

from .components import components


def follow(links: DataFrame, *, sums: tuple[str, ...] = (), tops: tuple[str, ...] = (), most_rounds: int = 60) -> DataFrame:
    """(node, to, steps, *sums, *tops): where each node of ``links`` (node, to, *sums, *tops) ends, the links until there, and the sums and largest values over them.

    Links may meet (a forest) but must not close a ring; there it raises.
    """
    cols = ("steps", *sums, *tops)
    going = stash(links.select("node", "to", F.lit(1).cast("long").alias("steps"), *sums, *tops), "follow")
    done = None
    for _ in range(most_rounds):
        # what has come to its end is looked up but not carried on
        every = going if done is None else going.unionByName(done)
        ahead = every.select(F.col("node").alias("to"), F.col("to").alias("_to"), *(F.col(c).alias(f"_{c}") for c in cols))
        met = stash(
            going.join(ahead, "to", "left").select("node", F.coalesce("_to", "to").alias("to"), *((F.greatest(c, f"_{c}") if c in tops else F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in cols), F.col("_to").isNotNull().alias("moved")),
            "follow",
        )
        ended = met.where("NOT moved").drop("moved")
        done = ended if done is None else done.unionByName(ended)
        going = met.where("moved").drop("moved")
        if going.isEmpty():
            return done
    raise RuntimeError(f"links form a ring, or a chain of over 2**{most_rounds} nodes")


def _paths(pdf: pd.DataFrame) -> pd.DataFrame:
    """What links within one block make of its nodes: the first node of each one's path, how far it is from there, and at a path's last node where its link leads out. A ring begins at its least node."""
    pdf = pdf.sort_values("node", ignore_index=True)
    node, to = pdf["node"].to_numpy("int64"), pdf["to"].to_numpy("int64")
    every, n = np.arange(len(node)), len(node)
    nxt = np.minimum(np.searchsorted(node, to), n - 1)
    inside = node[nxt] == to
    back = np.full(n, -1)
    back[nxt[inside]] = every[inside]

    def walked(back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, far = np.where(back < 0, every, back), (back >= 0).astype("int64")
        for _ in range(n.bit_length()):
            far, at = far + far[at], at[at]
        return at, far

    at, _ = walked(back)
    ring, least, jump = back[at] >= 0, every.copy(), np.where(back < 0, every, back)
    for _ in range(n.bit_length() if ring.any() else 0):
        least, jump = np.minimum(least, least[jump]), jump[jump]
    at, far = walked(np.where(ring & (least == every), -1, back))
    return pd.DataFrame({"node": node, "head": node[at], "off": far, "closed": ring, "out": pd.Series(to, dtype="Int64").mask(inside)})


def _by_blocks(links: DataFrame, block: Column) -> DataFrame:
    ship(links.sparkSession)
    part = links.select("node", "to", block.alias("_block")).groupBy("_block").applyInPandas(_paths, "node long, head long, off long, closed boolean, out long")
    part = stash(part, "paths")
    # one row a path that leaves its block; where it leads to is the first node of another one, or a node without a link
    leaves = part.where("NOT closed").groupBy("head").agg(F.max("out").alias("to"), F.count("*").alias("len"), F.min(F.struct("node", "off")).alias("low"))
    leaves = stash(leaves, "leaves")
    ends = leaves.select(F.col("to").alias("head")).join(leaves.select("head"), "head", "left_anti")
    each = leaves.unionByName(ends.select("head", F.lit(None).cast("long").alias("to"), F.lit(1).cast("long").alias("len"), F.struct(F.col("head").alias("node"), F.lit(0).cast("long").alias("off")).alias("low")))
    member = components(leaves, "head", "to").withColumnRenamed("node", "head")
    each = stash(each.join(member, "head"), "each")
    size = stash(each.groupBy("component").agg((F.count("*") == F.count("to")).alias("ring"), F.sum("len").alias("nodes"), F.min("low.node").alias("chain")), "sizes")
    into = each.where("to = component").join(size.where("ring"), "component", "left_semi").select("head", "to")
    left = follow(each.where("to IS NOT NULL").join(into, ["head", "to"], "left_anti").select(F.col("head").alias("node"), "to", "len"), sums=("len",))
    ahead = each.join(left.select(F.col("node").alias("head"), F.col("len").alias("ahead")), "head", "left").join(size, "component")
    # what is ahead of a path is itself and those up to the last one, which isn't in it
    last = each.join(left.select(F.col("node").alias("head")), "head", "left_anti").select("component", F.col("len").alias("tail"))
    begun = ahead.join(last, "component").withColumn("start", F.col("nodes") - F.col("tail") - F.coalesce("ahead", F.lit(0)))
    begun = stash(begun.select("head", "component", "ring", "nodes", "chain", "start", F.col("low")), "begun")
    zero = begun.where("low.node = chain").select("component", (F.col("start") + F.col("low.off")).alias("zero"))
    placed = stash(begun.join(zero, "component").select("head", "chain", "ring", "nodes", F.when(F.col("ring"), F.col("start") - F.col("zero")).otherwise(F.col("start")).alias("start")), "placed")
    open_ = part.where("NOT closed").select("node", "head", "off").unionByName(ends.select(F.col("head").alias("node"), "head", F.lit(0).cast("long").alias("off")))
    at = F.col("start") + F.col("off")
    got = open_.join(placed, "head").select("node", "chain", "ring", F.when(F.col("ring"), F.pmod(at, F.col("nodes"))).otherwise(at).alias("pos"))
    return got.unionByName(part.where("closed").select("node", F.col("head").alias("chain"), F.lit(True).alias("ring"), F.col("off").alias("pos")))


def chains(links: DataFrame, *, block: Column | None = None) -> DataFrame:
    """(node, chain, ring, pos): the chain of each node of ``links`` (node, to), named by its least node, and its place in it from 0.

    No two links may lead to one node. ``ring``: whether the chain closes; a ring begins at its least node. ``block``: a part of the nodes, of a size that fits a task, in which most of what
    is linked lies together; then links within blocks are followed in one task each, and the rounds are only of what leaves its block.
    """
    if block is not None:
        return _by_blocks(links, block)
    links = stash(links.select("node", "to"), "links")
    member = stash(components(links.where("node <> to"), "node", "to").unionByName(links.where("node = to").select("node", F.col("node").alias("component"))), "member")
    named = links.join(member, "node")
    size = member.groupBy("component").agg(F.count("*").alias("nodes")).join(named.groupBy("component").agg(F.count("*").alias("n")), "component")
    size = stash(size.select("component", (F.col("nodes") == F.col("n")).alias("ring"), "nodes"), "sizes")
    # only the link into a ring's least node can lead to the component's name and close it
    into = named.where("to = component").join(size.where("ring"), "component", "left_semi").select("node", "to")
    left = follow(links.join(into, ["node", "to"], "left_anti"))
    steps = member.join(left.select("node", "steps"), "node", "left").select("node", "component", F.coalesce("steps", F.lit(0)).alias("steps"))
    return steps.join(size, "component").select("node", F.col("component").alias("chain"), "ring", (F.col("nodes") - 1 - F.col("steps")).alias("pos"))


def ancestors(links: DataFrame, starts: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(*starts, at, step): every node on the way from each start's ``node`` over ``links`` (node, to), itself at step 0.

    Jumps of 1, 2, 4, ... links are made first, as long as some start can use one; then every jump, the widest first, doubles what is known of each way.
    """
    jump, jumps = stash(links.select("node", "to"), "jump"), []
    tops = starts.select("node").distinct()
    for _ in range(most_rounds):
        if jump.join(tops, "node", "left_semi").isEmpty():
            break
        jumps.append(jump)
        jump = stash(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("_to")), "to").select("node", F.col("_to").alias("to")), "jump")
    else:
        raise RuntimeError("links form a ring")
    way = starts.withColumn("at", F.col("node")).withColumn("step", F.lit(0).cast("long"))
    for k in reversed(range(len(jumps))):
        further = way.join(jumps[k].withColumnsRenamed({"node": "at", "to": "_to"}), "at").select(*starts.columns, F.col("_to").alias("at"), (F.col("step") + (1 << k)).alias("step"))
        way = stash(way.unionByName(further), "way")
    return way


def gathered(nodes: DataFrame, links: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, weight): the weights of ``nodes`` (node, weight) with those of all nodes from which ``links`` (node, to) lead there, near or far.

    Each round adds what lies as far again as is known already.
    """
    nodes, jump = stash(nodes.select("node", "weight"), "weights"), stash(links.select("node", "to"), "jump")
    for _ in range(most_rounds):
        if jump.isEmpty():
            return nodes
        come = nodes.join(jump, "node").groupBy(F.col("to").alias("node")).agg(F.sum("weight").alias("_come"))
        nodes = stash(nodes.join(come, "node", "left").select("node", (F.col("weight") + F.coalesce("_come", F.lit(0))).alias("weight")), "weights")
        jump = stash(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("_to")), "to").select("node", F.col("_to").alias("to")), "jump")
    raise RuntimeError("links form a ring")


def running(rows: DataFrame, order: list[str], *, sums: tuple[str, ...] = (), xors: tuple[str, ...] = (), lasts: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with each of the columns replaced by its sum, exclusive or, or last value that isn't null over all rows up to that one in the order.

    Ranges are put in order apart, and what the ranges before come to is added: one row a range reaches the driver, spark.sql.shuffle.partitions at most. Among rows
    that are equal in the order anyone may come first, so for the same result every time it must be without ties.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stash(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    kinds = dict(rows.dtypes)
    inside = {**{c: F.sum(c) for c in sums}, **{c: F.bit_xor(c) for c in xors}, **{c: F.last(c, ignorenulls=True) for c in lasts}}
    by_order = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = F.struct(*[F.col(c) for c in order])
    whole = {c: f if c not in lasts else F.max_by(c, F.when(F.col(c).isNotNull(), named)) for c, f in inside.items()}
    totals = sorted(ranged.groupBy("_part").agg(*(f.alias(c) for c, f in whole.items())).collect(), key=lambda r: r["_part"])

    def before(c: str) -> list:
        if c in lasts:
            return list(accumulate([None, *(t[c] for t in totals)], lambda a, b: a if b is None else b))
        number = float if kinds[c] in ("double", "float") else int
        return list(accumulate([number(0), *(number(t[c] or 0) for t in totals)], (lambda a, b: a + b) if c in sums else (lambda a, b: a ^ b)))

    fields = ", ".join(["_part int", *(f"_{c} {kinds[c]}" for c in inside)])
    offsets = spark.createDataFrame(list(zip((t["_part"] for t in totals), *(before(c) for c in inside), strict=False)), fields)
    got = ranged.select(*(F.col(c) if c not in inside else inside[c].over(by_order).alias(c) for c in rows.columns), "_part").join(F.broadcast(offsets), "_part")
    put = lambda c: F.col(c) + F.col(f"_{c}") if c in sums else F.col(c).bitwiseXOR(F.col(f"_{c}")) if c in xors else F.coalesce(c, f"_{c}") if c in lasts else F.col(c)
    return got.select(*(put(c).alias(c) for c in rows.columns))
