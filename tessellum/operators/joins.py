"""Joins by rule: aliases with reports of what didn't match, priorities, votes and weighted nearest labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.plans.stages import spread as stash

from .chains import chains
from .spatial import within


def matched_by_name(left: DataFrame, right: DataFrame, *, left_key: Column, right_key: Column, aliases: dict[str, str] | None = None) -> DataFrame:
    """Left join on a normalised key, after aliases have been put in for keys that have one."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    wanted = F.coalesce(F.try_element_at(table, left_key), left_key) if aliases else left_key
    return left.withColumn("_k", wanted).join(right.withColumn("_k", right_key), "_k", "left").drop("_k")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one side that the other lacks."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def first_known(points: DataFrame, sources: list[tuple[str, DataFrame]], *, key: str, value: str) -> DataFrame:
    """(key, value, source): from the first source in the list that has a value; null and '' from none."""
    out = points.select(key)
    for i, (_, df) in enumerate(sources):
        out = out.join(df.select(key, F.col(value).alias(f"_v{i}")), key, "left")
    named = F.lit(None).cast("string")
    for i, (name, _) in reversed(list(enumerate(sources))):
        named = F.when(F.col(f"_v{i}").isNotNull(), F.lit(name)).otherwise(named)
    return out.select(key, F.coalesce(*[F.col(f"_v{i}") for i in range(len(sources))]).alias(value), F.coalesce(named, F.lit("")).alias("source"))


def last_file_wins(parts: list[DataFrame], *, key: str) -> DataFrame:
    """Rows of several tables of one shape; of a key that several have, the last table's."""
    both = None
    for i, p in enumerate(parts):
        p = p.withColumn("_i", F.lit(i))
        both = p if both is None else both.unionByName(p)
    rest = [c for c in parts[0].columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), "_i").alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def nearest_label(points: DataFrame, labels: DataFrame, *, key: str, name: str, distance: Column, weight: Column) -> DataFrame:
    """(key, name): the label of least weighted distance. ``labels`` is a short list of names, counted and broadcast."""
    n = labels.count()
    if n > 10_000:
        raise ValueError(f"{n} labels: use spatial.nearest")
    # a point's rows are made where they are brought together: dealt first, by key, over all tasks
    spark = points.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), points.count() // 50_000)
    met = points.repartition(parts, key).join(F.broadcast(labels), F.lit(True))
    return met.groupBy(key).agg(F.min(F.struct((distance * weight).alias("d"), F.col(name))).alias("m")).select(key, F.col(f"m.{name}").alias(name))


def interval_hits(left: DataFrame, right: DataFrame, *, key: str, least: float) -> DataFrame:
    """Pairs within a key whose intervals (lo, hi) share more than ``least``: (key, l, r, shared), l and r being the ids."""
    a = left.select(key, F.col("id").alias("l"), F.col("lo").alias("a0"), F.col("hi").alias("a1"))
    b = right.select(key, F.col("id").alias("r"), F.col("lo").alias("b0"), F.col("hi").alias("b1"))
    shared = F.least("a1", "b1") - F.greatest("a0", "b0")
    return a.join(b, key).withColumn("shared", shared).where(F.col("shared") > least).select(key, "l", "r", "shared")


def shared_borders(edges: DataFrame, *, owner: str) -> DataFrame:
    """(a, b, length): border between two owners, from polygon edges (x0, y0, x1, y1) that both have, in either direction."""
    one, two = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    keyed = edges.select(owner, F.least(one, two).alias("p"), F.greatest(one, two).alias("q"), F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("length"))
    sides = keyed.groupBy("p", "q").agg(F.min(owner).alias("a"), F.max(owner).alias("b"), F.count("*").alias("n"), F.first("length").alias("length"))
    return sides.where("n = 2 AND a <> b").groupBy("a", "b").agg(F.sum("length").alias("length"))


def votes(matches: DataFrame, *, by: str, code: str, length: Column, whole: Column, least_share: float) -> DataFrame:
    """(by, code): the code most of the length was matched to, if the matched length is at least a share of the whole."""
    per = matches.groupBy(by, code).agg(F.sum(length).alias("n"), F.max(whole).alias("w"))
    got = per.groupBy(by).agg(F.max(F.struct("n", F.col(code))).alias("m"), (F.sum("n") / F.max("w")).alias("share"))
    return got.where(F.col("share") >= least_share).select(by, F.col(f"m.{code}").alias(code))


def lagged_pairs(steps: DataFrame, *, route: str, order: str, node: str) -> DataFrame:
    """(route, a, b): consecutive nodes of each route."""
    w = Window.partitionBy(route).orderBy(order)
    return steps.select(route, F.col(node).alias("a"), F.lead(node).over(w).alias("b")).where("b IS NOT NULL")


def joined_ways(ways: DataFrame, *, gap: float) -> DataFrame:
    """(chain, ring, pos, way, turned, gap): ways (way, x0, y0, x1, y1) put end to end, each turned where it has to be.

    Two ends meet if each is the other's nearest end of another way, the one of the lesser number on ties, and they are no more than ``gap`` apart; ``gap`` is how far the way's beginning is from the
    end before. Both directions of every way are linked, so a chain comes twice; the one in which its way of least number isn't turned stays, and names it.
    """
    ends = ways.select("way", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (0, 1)])).alias("e"))
    ends = stash(ends.select((F.col("way") * 2 + F.col("e.k")).alias("end"), F.col("e.x").alias("x"), F.col("e.y").alias("y")), "ends")
    near = within(ends.withColumnRenamed("end", "p"), ends.withColumnRenamed("end", "q"), lid="p", rid="q", radius=gap).where(F.floor(F.col("p") / 2) != F.floor(F.col("q") / 2))
    best = stash(near.groupBy("p").agg(F.min(F.struct("dist", "q")).alias("m")).select("p", F.col("m.q").alias("q"), F.col("m.dist").alias("dist")), "nearest")
    pairs = best.join(best.select(F.col("q").alias("p"), F.col("p").alias("q")), ["p", "q"])
    # node 2w goes along way w, node 2w + 1 against it: it leaves at end 1 or 0, and the next is entered at the end met
    links = stash(pairs.select((F.col("p") + F.when(F.col("p") % 2 == 1, -1).otherwise(1)).alias("node"), F.col("q").alias("to"), "dist"), "links")
    placed = chains(links.select("node", "to"))
    every = ways.select(F.explode(F.array(F.col("way") * 2, F.col("way") * 2 + 1)).alias("node")).join(placed, "node", "left")
    kept = every.select("node", F.coalesce("chain", "node").alias("chain"), F.coalesce("ring", F.lit(False)).alias("ring"), F.coalesce("pos", F.lit(0)).alias("pos")).where("chain % 2 = 0")
    come = links.select(F.col("to").alias("node"), F.col("dist").alias("gap"))
    return kept.join(come, "node", "left").select((F.col("chain") / 2).cast("long").alias("chain"), "ring", "pos", F.floor(F.col("node") / 2).alias("way"), (F.col("node") % 2 == 1).alias("turned"), "gap")
