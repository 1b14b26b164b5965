"""Spatial joins on plain coordinate columns: grid cells turn them into equi-joins.

A cell's rows may be many; the joins are shuffled by (cell), and what is compared is the cell's and not the
whole table's rows. ``size`` must be at least the search radius where a radius is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges_of(polygons: DataFrame, *, ring: str, keep: list[str]) -> DataFrame:
    """One row an edge (x0, y0, x1, y1) of closed rings given as arrays of (x, y)."""
    points = polygons.select(*keep, F.posexplode(F.arrays_zip(F.col(ring).alias("p"), F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1)).alias("q"))).alias("i", "e"))
    return points.select(*keep, "i", F.col("e.p.x").alias("x0"), F.col("e.p.y").alias("y0"), F.col("e.q.x").alias("x1"), F.col("e.q.y").alias("y1"))


def points_in_polygons(points: DataFrame, edges: DataFrame, *, point: str, polygon: str, bucket: float, x: str = "x", y: str = "y") -> DataFrame:
    """(point, polygon) by the even-odd rule: edges crossed to the right, each edge half open in y, bucketed by y."""
    bands = edges.where("y0 <> y1").withColumn("band", F.explode(F.sequence(F.floor(F.least("y0", "y1") / bucket), F.floor(F.greatest("y0", "y1") / bucket))))
    p = points.select(F.col(point), F.col(x).alias("px"), F.col(y).alias("py"), F.floor(F.col(y) / bucket).alias("band"))
    crossed = ((F.col("y0") > F.col("py")) != (F.col("y1") > F.col("py"))) & (F.col("px") < (F.col("x1") - F.col("x0")) * (F.col("py") - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0"))
    hits = p.join(bands.select(polygon, "band", "x0", "y0", "x1", "y1"), "band").where(crossed)
    return hits.groupBy(point, polygon).agg(F.count("*").alias("n")).where("n % 2 = 1").select(point, polygon)


def polygon_measures(edges: DataFrame, *, polygon: str) -> DataFrame:
    """(polygon, area, length)."""
    cross = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    return edges.groupBy(polygon).agg((F.abs(F.sum(cross)) / 2).alias("area"), F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("length"))


def _cells(df: DataFrame, x: str, y: str, size: float, ring: int) -> DataFrame:
    step = F.sequence(F.lit(-ring), F.lit(ring))
    out = df.withColumn("_i", F.floor(F.col(x) / size)).withColumn("_j", F.floor(F.col(y) / size))
    if ring:
        out = out.withColumn("_di", F.explode(step)).withColumn("_dj", F.explode(step)).withColumn("_i", F.col("_i") + F.col("_di")).withColumn("_j", F.col("_j") + F.col("_dj")).drop("_di", "_dj")
    return out


def within(left: DataFrame, right: DataFrame, *, lid: str, rid: str, radius: float, own: tuple[str, ...] = (), other: tuple[str, ...] = (), fine: int = 1) -> DataFrame:
    """(lid, rid, dist, *own, *other) of all points within the radius; ``own`` and ``other`` are further columns of left and right.

    The left side stands in one cell, the right in those around it. ``fine`` cells make a radius: with 3 fewer pairs are looked at in vain (1.7 instead of 2.9
    for each that is found) and the work falls into more cells, but the right side is written 49 instead of 9 times; right for many partners, wrong for few.
    The left side is dealt by cell over all tasks, however few bytes it has: the work is in the pairs.
    The join is always shuffled: the planner doesn't see that the right side's rows are written many times, and would broadcast them.
    """
    spark = left.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    a = _cells(left.select(F.col(lid), F.col("x").alias("ax"), F.col("y").alias("ay"), *own), "ax", "ay", radius / fine, 0).repartition(parts, "_i", "_j")
    b = _cells(right.select(F.col(rid), F.col("x").alias("bx"), F.col("y").alias("by"), *other), "bx", "by", radius / fine, fine)
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return a.hint("merge").join(b, ["_i", "_j"]).withColumn("dist", F.sqrt(dx * dx + dy * dy)).where(F.col("dist") <= radius).select(lid, rid, "dist", *own, *other)


def _first_radius(points: DataFrame, places: DataFrame, size: float, *, halvings: int = 16, crowd: float = 8.0) -> float:
    """``size`` halved until a place shares its cell with few others on average; one row a halving comes to the driver."""
    far = max(df.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 0.0 for df in (points, places))
    most = [k for k in range(halvings + 1) if far / size * 2**k < 2**60]
    if len(most) < 2:
        return size
    at = places.select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(most[-1]))).alias("k"))
    scale = F.pow(F.lit(2.0), F.col("k")) / size
    count = at.groupBy("k", F.floor(F.col("x") * scale).alias("i"), F.floor(F.col("y") * scale).alias("j")).agg(F.count("*").cast("double").alias("n"))
    met = {r["k"]: r["m"] for r in count.groupBy("k").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("m")).collect()}
    return size / 2 ** next((k for k in most if met.get(k, 0.0) <= crowd), most[-1])


def nearest(left: DataFrame, right: DataFrame, *, lid: str, rid: str, size: float, reach: float | None = None, own: tuple[str, ...] = (), other: tuple[str, ...] = (), where: Column | None = None) -> DataFrame:
    """(lid, rid, dist) of the nearest point, the smaller id on ties: the search radius doubles until all are served.

    It begins at ``size`` or, where places stand close, at a part of it, so that a point meets few places however many there are. Only places for which ``where`` (a
    condition on the columns ``own`` of left and ``other`` of right) holds count, and with ``reach`` only those no further away. Points alike in place and columns are looked up
    once. Points without finite coordinates have no row, and none has one if there is nothing to be near to.
    """
    from tessellum.plans.stages import stash

    finite = "abs(x) < double('infinity') AND abs(y) < double('infinity')"
    asked = stash(left.where(finite).select("x", "y", *own).distinct().withColumn("_q", F.monotonically_increasing_id()), "asked")
    places = stash(right.where(finite).groupBy("x", "y", *other).agg(F.min(rid).alias(rid)), "places")
    radius = _first_radius(asked, places, size if reach is None else min(size, reach))
    waiting, done, empty = asked, None, places.isEmpty()
    while True:
        near = within(waiting, places, lid="_q", rid=rid, radius=radius, own=own, other=other)
        near = near if where is None else near.where(where)
        got = stash(near.groupBy("_q").agg(F.min(F.struct("dist", rid)).alias("m")).select("_q", F.col(f"m.{rid}").alias(rid), F.col("m.dist").alias("dist")), "nearest")
        done = got if done is None else done.unionByName(got)
        if empty or (reach is not None and radius >= reach):
            break
        waiting = stash(waiting.join(got.select("_q"), "_q", "left_anti"), "waiting")
        if waiting.isEmpty():
            break
        radius = radius * 2 if reach is None else min(radius * 2, reach)
    served = asked.join(done, "_q").drop("_q")
    met = left.where(finite).select(lid, "x", "y", *own).join(served, ["x", "y", *own])
    return met.groupBy(lid).agg(F.min(F.struct("dist", rid)).alias("m")).select(lid, F.col(f"m.{rid}").alias(rid), F.col("m.dist").alias("dist"))


def raster_lookup(points: DataFrame, cells: DataFrame, *, east: float, north: float, value: str = "v", step: float = 1.0, outside: object = 0) -> DataFrame:
    """The value of the cell (r, c) a point lies in; outside the grid, or without a cell, ``outside``."""
    r, c = F.floor((F.lit(north) - F.col("y")) / step), F.floor((F.col("x") - F.lit(east)) / step)
    return points.withColumn("r", r).withColumn("c", c).join(cells.select("r", "c", value), ["r", "c"], "left").withColumn(value, F.coalesce(value, F.lit(outside)))


def bilinear(points: DataFrame, cells: DataFrame, *, pid: str, value: str = "v") -> DataFrame:
    """(pid, value) from the four cell centres around a point in cell units; null unless all four are known."""
    fx, fy = F.col("x") - 0.5, F.col("y") - 0.5
    at = points.select(pid, fx.alias("fx"), fy.alias("fy"), F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("o"))
    at = at.withColumn("c", F.floor("fx") + F.col("o.a")).withColumn("r", F.floor("fy") + F.col("o.b"))
    w = (1 - F.abs(F.col("fx") - F.col("c"))) * (1 - F.abs(F.col("fy") - F.col("r")))
    got = at.join(cells.select("r", "c", value), ["r", "c"], "left").groupBy(pid).agg(F.sum(w * F.col(value)).alias("s"), F.count(value).alias("n"))
    return got.select(pid, F.when(F.col("n") == 4, F.col("s")).alias(value))


def neighbourhood(cells: DataFrame, *, value: str = "v", reach: int = 2) -> DataFrame:
    """A cell's own value, else the least within reach: (r, c, own, filled)."""
    step = F.sequence(F.lit(-reach), F.lit(reach))
    spread = cells.where(F.col(value).isNotNull()).select("r", "c", F.col(value).alias("n")).withColumn("dr", F.explode(step)).withColumn("dc", F.explode(step))
    near = spread.groupBy((F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c")).agg(F.min("n").alias("near"))
    return cells.join(near, ["r", "c"], "left").select("r", "c", F.col(value).alias("own"), F.coalesce(value, "near").alias("filled"))


def slope(cells: DataFrame, *, value: str = "v", size: float = 1.0) -> DataFrame:
    """(r, c, slope in degrees, aspect) by central differences; cells without four neighbours are left out."""
    sides = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(n).alias("n")) for n, dr, dc in (("n", 1, 0), ("s", -1, 0), ("w", 0, 1), ("e", 0, -1))])
    sent = cells.select("r", "c", value, F.explode(sides).alias("o")).select((F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), F.col("o.n").alias("n"), value)
    got = sent.groupBy("r", "c").agg(*[F.max(F.when(F.col("n") == k, F.col(value))).alias(k) for k in "nswe"])
    dx, dy = (F.col("e") - F.col("w")) / (2 * size), (F.col("n") - F.col("s")) / (2 * size)
    own = cells.where(F.col(value).isNotNull()).select("r", "c")
    from tessellum.functions.geo import bearing

    return got.where("n IS NOT NULL AND s IS NOT NULL AND w IS NOT NULL AND e IS NOT NULL").join(own, ["r", "c"]).select("r", "c", F.degrees(F.atan(F.hypot(dx, dy))).alias("slope"), bearing(-dx, -dy).alias("aspect"))


def affine_fit(pairs: DataFrame, *, x: str, y: str, target: str) -> Column | tuple:
    """(a, b, c) of target = a * x + b * y + c by least squares, from one row of sums."""
    s = pairs.agg(*[F.covar_pop(i, j).alias(n) for n, i, j in (("xx", x, x), ("xy", x, y), ("yy", y, y), ("xt", x, target), ("yt", y, target))], F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(target).alias("mt"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    a, b = (F.col("xt") * F.col("yy") - F.col("yt") * F.col("xy")) / det, (F.col("yt") * F.col("xx") - F.col("xt") * F.col("xy")) / det
    return s.select(a.alias("a"), b.alias("b"), (F.col("mt") - a * F.col("mx") - b * F.col("my")).alias("c"))


def interval_overlap(left: DataFrame, right: DataFrame, *, key: str) -> DataFrame:
    """(key, overlap): total length that intervals (lo, hi) of two tables share within a key."""
    a, b = left.select(key, F.col("lo").alias("a0"), F.col("hi").alias("a1")), right.select(key, F.col("lo").alias("b0"), F.col("hi").alias("b1"))
    lo, hi = F.greatest("a0", "b0"), F.least("a1", "b1")
    return a.join(b, key).where(lo < hi).groupBy(key).agg(F.sum(hi - lo).alias("overlap"))


def path_encode(points: DataFrame, *, key: str, order: str, digits: int = 1) -> DataFrame:
    """(key, d): relative path strings of quantised points, repeats left out."""
    k = 10**digits
    q = points.select(key, order, F.round(F.col("x") * k).cast("long").alias("qx"), F.round(F.col("y") * k).cast("long").alias("qy"))
    w = Window.partitionBy(key).orderBy(order)
    step = q.withColumn("dx", F.col("qx") - F.lag("qx", 1).over(w)).withColumn("dy", F.col("qy") - F.lag("qy", 1).over(w))
    number = lambda c: (F.col(c) / k).cast(f"decimal(18,{digits})").cast("string")
    first = F.col("dx").isNull()
    part = F.when(first, F.concat(F.lit("M"), number("qx"), F.lit(","), number("qy"))).otherwise(F.concat(F.lit("l"), number("dx"), F.lit(","), number("dy")))
    kept = step.where(first | (F.col("dx") != 0) | (F.col("dy") != 0)).select(key, order, part.alias("s"))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "s"))), lambda x: x["s"]), "").alias("d"))


def similarity_fit(pairs: DataFrame, *, x: str, y: str, u: str, v: str) -> DataFrame:
    """(a, b, tx, ty) of u = a * x - b * y + tx, v = b * x + a * y + ty by least squares, from one row of sums."""
    c = lambda i, j: F.covar_pop(i, j)
    s = pairs.agg((c(x, u) + c(y, v)).alias("p"), (c(x, v) - c(y, u)).alias("q"), (c(x, x) + c(y, y)).alias("n"), *[F.avg(k).alias(f"m{i}") for i, k in enumerate((x, y, u, v))])
    a, b = F.col("p") / F.col("n"), F.col("q") / F.col("n")
    return s.select(a.alias("a"), b.alias("b"), (F.col("m2") - a * F.col("m0") + b * F.col("m1")).alias("tx"), (F.col("m3") - b * F.col("m0") - a * F.col("m1")).alias("ty"))
