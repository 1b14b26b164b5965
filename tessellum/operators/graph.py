"""Graphs as edge tables: shortest paths, components' helpers, bridges, contraction and paths.

Iterations run on the cluster with the lineage cut each round; what comes to the driver is a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.plans.stages import stash

from .components import components
from .trees import bridges


def undirected(edges: DataFrame, *, u: str = "u", v: str = "v") -> DataFrame:
    """Both directions of each edge."""
    rest = [c for c in edges.columns if c not in (u, v)]
    return edges.select(u, v, *rest).unionByName(edges.select(F.col(v).alias(u), F.col(u).alias(v), *rest))


def shortest_paths(edges: DataFrame, sources: DataFrame, *, u: str = "u", v: str = "v", weight: str = "w", closed: DataFrame | None = None, cutoff: float | None = None, most_rounds: int = 1000) -> DataFrame:
    """(node, source, dist): the nearest source of each node over directed edges, the smaller source on ties.

    ``sources`` is (node, source, dist): a virtual root with its own start distances. Edges in ``closed`` (u, v)
    are left out. Each round only the nodes that came nearer send to their neighbours; rounds go on until
    none does. Unreached nodes have no row.
    """
    open_edges = edges if closed is None else edges.join(closed.select(u, v), [u, v], "left_anti")
    net = open_edges.where(F.col(weight).isNotNull()).groupBy(F.col(u).alias("a"), F.col(v).alias("b")).agg(F.min(weight).cast("double").alias("w"))
    net = stash(net, "net")
    best = lambda df: df.groupBy("node").agg(F.min(F.struct("dist", "source")).alias("m")).select("node", F.col("m.source").alias("source"), F.col("m.dist").alias("dist"))
    reached = stash(best(sources.select("node", "source", F.col("dist").cast("double").alias("dist"))), "reached")
    front = reached
    for _ in range(most_rounds):
        sent = front.join(net, front.node == net.a).select(F.col("b").alias("node"), "source", (F.col("dist") + F.col("w")).alias("dist"))
        if cutoff is not None:
            sent = sent.where(F.col("dist") <= cutoff)
        come = best(sent).alias("n")
        old = reached.alias("o")
        closer = F.col("o.node").isNull() | (F.struct("n.dist", "n.source") < F.struct("o.dist", "o.source"))
        front = stash(come.join(old, F.col("n.node") == F.col("o.node"), "left").where(closer).select("n.node", "n.source", "n.dist"), "front")
        if front.isEmpty():
            return reached
        reached = stash(reached.join(front.select("node"), "node", "left_anti").select("node", "source", "dist").unionByName(front), "reached")
    raise RuntimeError(f"paths didn't settle in {most_rounds} rounds")


def largest_component(edges: DataFrame, *, u: str = "u", v: str = "v") -> DataFrame:
    """(node) of the component with most nodes, the one with the least node on ties."""
    member = stash(components(edges, u, v), "member")
    top = member.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return member.join(F.broadcast(top.select("component")), "component", "left_semi").select("node")


def degrees(edges: DataFrame, *, u: str = "u", v: str = "v") -> DataFrame:
    return undirected(edges.select(u, v), u=u, v=v).groupBy(F.col(u).alias("node")).agg(F.count("*").alias("degree"))


def contracted(edges: DataFrame, *, u: str = "u", v: str = "v", weight: str = "w") -> DataFrame:
    """(chain, a, b, total, n): chains of edges through nodes of degree 2, between the nodes of other degree; a ring has null ends.

    Edges that share a node of degree 2 are joined by components over edge ids, so long chains take a
    logarithmic number of rounds.
    """
    numbered = stash(edges.select(F.least(u, v).alias("x"), F.greatest(u, v).alias("y"), F.col(weight).alias("w")).withColumn("id", F.xxhash64("x", "y", "w")), "numbered")
    ends = numbered.select("id", "w", F.explode(F.array("x", "y")).alias("node"))
    degree = ends.groupBy("node").agg(F.count("*").alias("degree"))
    inner = ends.join(degree.where("degree = 2"), "node").groupBy("node").agg(F.min("id").alias("u"), F.max("id").alias("v"))
    member = components(inner, "u", "v")
    chain = numbered.join(member, numbered.id == member.node, "left").select("id", "w", "x", "y", F.coalesce("component", "id").alias("chain"))
    outer = chain.select("chain", F.explode(F.array("x", "y")).alias("node")).join(degree.where("degree <> 2"), "node")
    caps = outer.groupBy("chain").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    return chain.groupBy("chain").agg(F.sum("w").alias("total"), F.count("*").alias("n")).join(caps, "chain", "left").select("chain", "a", "b", "total", "n")


def trace(links: DataFrame, starts: DataFrame, *, src: str, dst: str, most_rounds: int = 10_000) -> DataFrame:
    """(start, node, step): all nodes reached from each start over directed links, each once, at its first step."""
    step = stash(links.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct(), "links")
    seen = stash(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("step")), "seen")
    front = seen
    for i in range(1, most_rounds + 1):
        new = front.join(step, front.node == step.a).select("start", F.col("b").alias("node")).distinct()
        front = stash(new.join(seen, ["start", "node"], "left_anti").withColumn("step", F.lit(i)), "front")
        if front.isEmpty():
            return seen
        seen = stash(seen.unionByName(front), "seen")
    raise RuntimeError(f"tracing didn't end in {most_rounds} steps")


def simple_paths(edges: DataFrame, *, start: object, end: object, stretch: float, u: str = "u", v: str = "v", weight: str = "w") -> DataFrame:
    """(path, length): all paths without a repeated node whose length is at most ``stretch`` times the shortest; weights must be positive."""
    # read in every round, so what it comes from is worked out once
    net = stash(edges.select(F.col(u).alias("a"), F.col(v).alias("b"), F.col(weight).cast("double").alias("w")), "net")
    first = net.sparkSession.createDataFrame([(start, start, 0.0)], "node long, source long, dist double")
    best = shortest_paths(net, first, u="a", v="b", weight="w").where(F.col("node") == F.lit(end)).select("dist").first()
    schema = "path array<bigint>, length double"
    if best is None:
        return net.sparkSession.createDataFrame([], schema)
    most = best[0] * stretch
    now = net.sparkSession.createDataFrame([([start], 0.0)], schema)
    done = net.sparkSession.createDataFrame([], schema)
    while True:
        on = now.join(net, F.element_at("path", -1) == net.a).where(~F.array_contains("path", F.col("b")))
        now = stash(on.select(F.array_append("path", F.col("b")).alias("path"), (F.col("length") + F.col("w")).alias("length")).where(F.col("length") <= most + 1e-9), "paths")
        if now.isEmpty():
            return done
        at_end = F.element_at("path", -1) == F.lit(end)
        done = done.unionByName(now.where(at_end))
        now = now.where(~at_end)


def grade_cost(length: Column, rise: Column, steps: Column, *, flat: float, steep: float, limit: float = 0.1, stair_speed: float = 0.3) -> Column:
    """Seconds over an edge: the steep speed beyond the grade limit, and stairs never faster than the stair speed."""
    speed = F.when(F.abs(rise) > limit * length, steep).otherwise(flat)
    return F.greatest(length / speed, F.when(steps, length / stair_speed).otherwise(0.0))


def shared_length(a: DataFrame, b: DataFrame, *, u: str = "u", v: str = "v", weight: str = "w") -> DataFrame:
    """(length): of the edges of route a that are also in route b, in either direction."""
    key = [F.least(u, v).alias("k1"), F.greatest(u, v).alias("k2")]
    return a.select(*key, weight).join(b.select(*key).distinct(), ["k1", "k2"], "left_semi").agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias("length"))


def oriented(paths: DataFrame, *, path: str, at_start: Column, at_end: Column) -> DataFrame:
    """Paths turned so that they end at the smaller distance."""
    return paths.withColumn(path, F.when(at_start < at_end, F.reverse(path)).otherwise(F.col(path)))


def plateaus(edges: DataFrame, *, start: object, end: object, u: str = "u", v: str = "v", weight: str = "w", stretch: float = 1.5) -> DataFrame:
    """(u, v, via): edges on shortest ways both from the start and to the end, and the length of the way through them, within the stretch."""
    one = lambda n: edges.sparkSession.createDataFrame([(n, n, 0.0)], "node long, source long, dist double")
    out = shortest_paths(edges, one(start), u=u, v=v, weight=weight).select(F.col("node").alias("n1"), F.col("dist").alias("d1"))
    back = shortest_paths(edges.select(F.col(v).alias(u), F.col(u).alias(v), weight), one(end), u=u, v=v, weight=weight).select(F.col("node").alias("n2"), F.col("dist").alias("d2"))
    e = edges.select(u, v, F.col(weight).cast("double").alias("w"))
    far = [t.select(F.col(n).alias(f"m{i}"), F.col(d).alias(f"e{i}")) for i, (t, n, d) in enumerate(((out, "n1", "d1"), (back, "n2", "d2")))]
    got = e.join(out, F.col(u) == F.col("n1")).join(far[0], F.col(v) == F.col("m0")).join(back, F.col(v) == F.col("n2")).join(far[1], F.col(u) == F.col("m1"))
    tight = (F.abs(F.col("d1") + F.col("w") - F.col("e0")) < 1e-9) & (F.abs(F.col("d2") + F.col("w") - F.col("e1")) < 1e-9)
    best = out.where(F.col("n1") == F.lit(end)).select(F.col("d1").alias("best"))
    return got.where(tight).crossJoin(F.broadcast(best)).select(u, v, (F.col("d1") + F.col("w") + F.col("d2")).alias("via"), "best").where(F.col("via") <= F.col("best") * stretch).drop("best")


__all__ = ["bridges", "contracted", "degrees", "grade_cost", "largest_component", "oriented", "plateaus", "shared_length", "shortest_paths", "simple_paths", "trace", "undirected"]
