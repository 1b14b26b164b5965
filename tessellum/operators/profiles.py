"""Lines as ordered vertices: places along them, pieces, offsets, labels and what lies beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions.geo import bearing
from tessellum.plans.stages import stash

from .chains import running
from .ordered import over
from .spatial import nearest


def measured(points: DataFrame, *, key: str, order: str) -> DataFrame:
    """``points`` (key, order, x, y) with d, the distance along the line."""
    w = over(key, order)
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return points.withColumn("_s", F.coalesce(step, F.lit(0.0))).withColumn("d", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def segments(line: DataFrame, *, key: str) -> DataFrame:
    """(key, d0, d1, x0, y0, x1, y1) between consecutive vertices of ``measured``; those without length are left out."""
    w = over(key, "d")
    nxt = [F.lead(c).over(w).alias(f"{c}1") for c in ("d", "x", "y")]
    return line.select(key, F.col("d").alias("d0"), F.col("x").alias("x0"), F.col("y").alias("y0"), *nxt).where("d1 > d0")


def lengths(line: DataFrame, *, key: str) -> DataFrame:
    return line.groupBy(key).agg(F.max("d").alias("length"))


def placed(segs: DataFrame, at: DataFrame, *, key: str, place: str, names: tuple[str, str] = ("x", "y")) -> DataFrame:
    """``at`` (key, place, ...) with the point of the line there, by a segment that reaches over the place."""
    s = segs.select(F.col(key).alias("_k"), *[F.col(n).alias(f"_{n}") for n in ("d0", "d1", "x0", "y0", "x1", "y1")])
    last = s.groupBy("_k").agg(F.max("_d1").alias("_end"))
    met = at.join(s.join(last, "_k"), (F.col(key) == F.col("_k")) & (F.col(place) >= F.col("_d0")) & ((F.col(place) < F.col("_d1")) | ((F.col(place) == F.col("_d1")) & (F.col("_d1") == F.col("_end")))))
    f = (F.col(place) - F.col("_d0")) / (F.col("_d1") - F.col("_d0"))
    return met.select(*at.columns, *[(F.col(f"_{n}0") + (F.col(f"_{n}1") - F.col(f"_{n}0")) * f).alias(to) for n, to in zip("xy", names, strict=True)])


def label_anchors(line: DataFrame, *, key: str, spacing: float, least: float, half: float) -> DataFrame:
    """(key, i, x, y, angle): evenly spaced anchors where the line is nearly straight over half a label either way; the angle is kept upright."""
    size = lengths(line, key=key).where(F.col("length") >= least)
    n = F.greatest(F.lit(1), F.floor(F.col("length") / spacing).cast("int"))
    at = size.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("p", (F.col("i") + 0.5) * F.col("length") / F.col("n"))
    at = at.withColumn("a", F.greatest(F.lit(0.0), F.col("p") - half)).withColumn("b", F.least("length", F.col("p") + half))
    segs = segments(line, key=key)
    for place, names in (("a", ("ax", "ay")), ("b", ("bx", "by")), ("p", ("x", "y"))):
        at = placed(segs, at, key=key, place=place, names=names)
    at = at.where(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) >= 1.7 * half)
    turn = F.degrees(F.atan2(-(F.col("by") - F.col("ay")), F.col("bx") - F.col("ax")))
    upright = F.when(turn > 90, turn - 180).when(turn <= -90, turn + 180).otherwise(turn)
    return at.select(key, "i", "x", "y", upright.alias("angle"))


def pieces(line: DataFrame, *, key: str, most: float) -> DataFrame:
    """(key, piece, direction, length): equal pieces of at most ``most``, with the axial mean direction of the line in them."""
    size = lengths(line, key=key).where("length > 0").withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("length") / most).cast("int")))
    cut = size.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("a", F.col("piece") * F.col("length") / F.col("n")).withColumn("b", (F.col("piece") + 1) * F.col("length") / F.col("n"))
    met = cut.join(segments(line, key=key), key).withColumn("w", F.least("d1", "b") - F.greatest("d0", "a")).where("w > 1e-9")
    turn = F.radians(bearing(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))) * 2
    got = met.groupBy(key, "piece").agg(F.sum(F.col("w") * F.cos(turn)).alias("c"), F.sum(F.col("w") * F.sin(turn)).alias("s"), F.sum("w").alias("length"))
    return got.select(key, "piece", F.pmod(F.degrees(F.atan2("s", "c")) / 2 + 180, F.lit(180.0)).alias("direction"), "length")


def along_and_off(places: DataFrame, line: DataFrame, *, place: str, key: str, reach: float) -> DataFrame:
    """(place, key, along, off): the nearest point of each line within reach of each place, by its distance along the line and from it.

    Segments are cut into pieces of at most the reach, which stand in the cells around them; a place looks in its own cell.
    """
    segs = segments(line, key=key).withColumn("_n", F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / reach).cast("int")))
    piece = segs.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda c, k: F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * k / F.col("_n")
    for c, i in (("x", "_i"), ("y", "_j")):
        a, b = at(c, F.col("_k")), at(c, F.col("_k") + 1)
        piece = piece.withColumn(i, F.explode(F.sequence(F.floor(F.least(a, b) / reach) - 1, F.floor(F.greatest(a, b) / reach) + 1)))
    near = piece.select(key, "x0", "y0", "x1", "y1", "d0", "d1", "_i", "_j").distinct()
    own = places.select(place, F.col("x").alias("px"), F.col("y").alias("py"), F.floor(F.col("x") / reach).alias("_i"), F.floor(F.col("y") / reach).alias("_j"))
    met = own.join(near, ["_i", "_j"])
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("px") - F.col("x0")) * dx + (F.col("py") - F.col("y0")) * dy) / (dx * dx + dy * dy)))
    off = F.hypot(F.col("px") - F.col("x0") - dx * f, F.col("py") - F.col("y0") - dy * f)
    along = F.col("d0") + (F.col("d1") - F.col("d0")) * f
    best = met.groupBy(place, key).agg(F.min(F.struct(off.alias("off"), along.alias("along"))).alias("m"))
    return best.select(place, key, F.col("m.along").alias("along"), F.col("m.off").alias("off")).where(F.col("off") <= reach)


def interpolated(reference: DataFrame, rows: DataFrame, *, at: str, value: str, name: str = "reference") -> DataFrame:
    """``rows`` with the reference line (at, value) read at their ``at`` linearly; beyond its ends the end's value.

    Both are put in one order by ranges; the line's points before and after a row are the last ones met from either side.
    """
    point = F.struct(F.col(at).cast("double").alias("a"), F.col(value).cast("double").alias("v"))
    line = reference.select(F.col(at).cast("double").alias("_x"), point.alias("_p"), F.lit(None).alias("_row")).where("_x IS NOT NULL")
    given = rows.select(F.col(at).cast("double").alias("_x"), F.lit(None).cast("struct<a: double, v: double>").alias("_p"), F.struct(*rows.columns).alias("_row"))
    both = line.withColumn("_row", F.lit(None).cast(given.schema["_row"].dataType)).unionByName(given)
    # a point at a row's own place counts as before it
    both = both.withColumns({"_before": F.col("_p"), "_after": F.col("_p"), "_back": -F.col("_x"), "_line": F.col("_p").isNotNull(), "_own": F.col("_p").isNull()})
    got = running(running(both, ["_x", "_own"], lasts=("_before",)), ["_back", "_line"], lasts=("_after",)).where("_own")
    part = (F.col("_x") - F.col("_before.a")) / (F.col("_after.a") - F.col("_before.a"))
    inner = F.col("_before.v") + (F.col("_after.v") - F.col("_before.v")) * part
    shown = F.when(F.col("_x").isNull(), F.lit(None)).when(F.col("_before").isNull(), F.col("_after.v")).when(F.col("_after").isNull(), F.col("_before.v")).otherwise(inner)
    return got.select("_row.*", shown.alias(name))


def signed_offsets(points: DataFrame, front: DataFrame, *, pid: str, order: str, slack: float = 5.0) -> DataFrame:
    """(pid, offset, inside): distance from the nearest front vertex, positive on the right of the front's direction there, and whether the point lies within its extent.

    The nearest vertex is looked for in cells (``spatial.nearest``), the earlier one on ties; its neighbours along the front are joined by their places.
    """
    vertex = stash(running(front.select(order, "x", "y").withColumn("_k", F.lit(1).cast("long")), [order], sums=("_k",)), "front")
    side = lambda n, step: vertex.select((F.col("_k") + step).alias("_k"), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"))
    turned = vertex.join(side("a", -1), "_k", "left").join(side("b", 1), "_k", "left")
    f = stash(turned.select("_k", F.col("x").alias("fx"), F.col("y").alias("fy"), *((F.coalesce(f"a{c}", c) - F.coalesce(f"b{c}", c)).alias(f"d{c}") for c in ("x", "y"))), "directions")
    low, high, left, right, n = front.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x"), F.count("*")).first()
    spacing = max(high - low, right - left) / n if n else 0.0
    met = nearest(points.select(pid, "x", "y"), vertex.select("_k", "x", "y"), lid=pid, rid="_k", size=max(spacing, 1e-9))
    size = F.hypot(F.col("dx"), F.col("dy"))
    off = ((F.col("x") - F.col("fx")) * F.col("dy") - (F.col("y") - F.col("fy")) * F.col("dx")) / size
    inside = F.col("y").between(low - slack, high + slack) if n else F.lit(False)
    return met.join(points.select(pid, "x", "y"), pid).join(f, "_k").select(pid, off.alias("offset"), inside.alias("inside"))


def canonical(chains: DataFrame, *, chain: str, a: str, b: str, length: str, same: str, share: float = 0.1) -> DataFrame:
    """(chain, canon): the chain of the smallest id with the same ends and mark and a length within the share, else itself."""
    c = chains.select(F.col(chain).alias("id"), F.least(a, b).alias("p"), F.greatest(a, b).alias("q"), F.col(length).alias("n"), F.col(same).alias("m"))
    # chains alike in all but the id have one answer: the least id among those within the share
    alike = c.groupBy("p", "q", "m", "n").agg(F.min("id").alias("id"))
    other = alike.select("p", "q", "m", F.col("n").alias("n2"), F.col("id").alias("id2"))
    met = alike.select("p", "q", "m", "n").join(other, ["p", "q", "m"]).where(F.abs(F.col("n2") - F.col("n")) < share * F.col("n"))
    least = met.groupBy("p", "q", "m", "n").agg(F.min("id2").alias("to"))
    return c.join(least, ["p", "q", "m", "n"], "left").select(F.col("id").alias(chain), F.coalesce(F.least("to", "id"), "id").alias("canon"))


def rollup(steps: DataFrame, chains: DataFrame, *, route: str, chain: str, direction: str) -> DataFrame:
    """(route, up, down, steepest, sums): what a route's chains add up to, each in its direction; ``chains`` has up, down, steep and a map of lengths."""
    met = steps.join(chains, chain)
    fore = F.col(direction) > 0
    flat = met.groupBy(route).agg(F.sum(F.when(fore, F.col("up")).otherwise(F.col("down"))).alias("up"), F.sum(F.when(fore, F.col("down")).otherwise(F.col("up"))).alias("down"), F.max(F.abs("steep")).alias("steepest"))
    each = met.select(route, F.explode("lengths").alias("name", "size")).groupBy(route, "name").agg(F.sum("size").alias("size"))
    sums = each.groupBy(route).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "size")))).alias("sums"))
    return flat.join(sums, route, "left")


def chained_legs(legs: DataFrame, *, tour: str, order: str, length: str) -> DataFrame:
    """``legs`` with ``offset``: what lies before each of a tour's legs."""
    w = Window.partitionBy(tour).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return legs.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0.0)))


def steepest_at_end(profile: DataFrame, *, key: str, at: str, value: str, steps: int, near: float) -> DataFrame:
    """(key, grade, from, at_end): the steepest stretch of so many steps, and whether it lies within reach of an end."""
    w = over(key, at)
    ahead = profile.select(key, F.col(at).alias("a"), F.col(value).alias("v"), F.lead(at, steps).over(w).alias("b"), F.lead(value, steps).over(w).alias("v2"))
    ends = profile.groupBy(key).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    best = ahead.where("b IS NOT NULL").groupBy(key).agg(F.max(F.struct((F.abs(F.col("v2") - F.col("v")) / (F.col("b") - F.col("a"))).alias("grade"), (-F.col("a")).alias("na"), F.col("b"))).alias("m"))
    return best.join(ends, key).select(key, F.col("m.grade").alias("grade"), (-F.col("m.na")).alias("from"), ((-F.col("m.na") - F.col("lo") < near) | (F.col("hi") - F.col("m.b") < near)).alias("at_end"))


def largest_of_way(links: DataFrame, *, way: str, weight: str, limit: int) -> DataFrame:
    """The link of most weight of each way, the heaviest ways first."""
    top = links.groupBy(way).agg(F.max(weight).alias(weight), F.count("*").alias("links"))
    return top.orderBy(F.desc(weight), way).limit(limit)


def relabelled(runs: DataFrame, stretches: DataFrame, *, key: str, label: str, old: str, new: str) -> DataFrame:
    """Runs (key, a, b, label) named ``old`` whose middle lies in a stretch (key, lo, hi) take the name ``new``."""
    s = stretches.select(F.col(key).alias("_k"), "lo", "hi")
    inside = (F.col(key) == F.col("_k")) & ((F.col("a") + F.col("b")) / 2 >= F.col("lo")) & ((F.col("a") + F.col("b")) / 2 < F.col("hi"))
    hit = runs.where(F.col(label) == old).join(s, inside, "left_semi").select(key, "a").withColumn("_hit", F.lit(True))
    return runs.join(hit, [key, "a"], "left").withColumn(label, F.when(F.col("_hit"), F.lit(new)).otherwise(F.col(label))).select(*runs.columns)


def permutation_p(df: DataFrame, *, value: str, chosen: Column, order: str, draws: int, seed: int) -> DataFrame:
    """(observed, p): mean of the chosen rows against the means of as many rows picked by hash in each draw; (number as large + 1) / (draws + 1).

    Every draw orders the rows by a hash of (seed, draw, row), so it takes draws times rows; the series must be short.
    """
    rows = df.select(F.col(value).alias("v"), F.col(order).alias("o"), chosen.alias("c"))
    k = rows.agg(F.count_if("c").alias("k"), F.avg(F.when(F.col("c"), F.col("v"))).alias("observed"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("o").cast("string"))), 1, 12), 16, 10).cast("long")
    each = rows.crossJoin(df.sparkSession.range(draws).withColumnRenamed("id", "draw")).withColumn("h", pick)
    rank = F.row_number().over(Window.partitionBy("draw").orderBy("h", "o"))
    means = each.withColumn("r", rank).crossJoin(F.broadcast(k)).where("r <= k").groupBy("draw", "observed").agg(F.avg("v").alias("m"))
    return means.groupBy("observed").agg(((F.count_if(F.col("m") >= F.col("observed") - 1e-12) + 1) / (F.lit(draws) + 1)).alias("p"))
