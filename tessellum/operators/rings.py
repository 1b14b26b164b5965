"""Outlines: rings of dissolved polygons and grids, contour lines put together, and lines simplified.

Everything is edge tables. What lies next to what is told by joins, and order along a ring or line by list ranking (``chains``), so no ring,
line or polygon has to fit the memory of a task. An edge goes from (x0, y0) to (x1, y1) with its polygon on the left: outer rings turn left, holes right.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellum.plans.stages import spread as stash

from .chains import chains
from .spatial import points_in_polygons

EDGE = ("x0", "y0", "x1", "y1")
#: Edges of a strip in which rings are followed in one task, roughly.
STRIP = 200_000


def cell_edges(cells: DataFrame, *, group: str, r: str = "r", c: str = "c") -> DataFrame:
    """(group, x0, y0, x1, y1): the four sides of every cell of a grid, in cells."""
    corner = [(0, 0), (1, 0), (1, 1), (0, 1)]
    sides = [F.struct((F.col(c) + a[0]).cast("double").alias("x0"), (F.col(r) + a[1]).cast("double").alias("y0"), (F.col(c) + b[0]).cast("double").alias("x1"), (F.col(r) + b[1]).cast("double").alias("y1")) for a, b in zip(corner, corner[1:] + corner[:1], strict=True)]
    return cells.select(group, F.explode(F.array(*sides)).alias("s")).select(group, "s.*")


def facing(edges: DataFrame, *, polygon: str) -> DataFrame:
    """The edges of simple polygons (each one ring) turned so that the polygon lies on the left."""
    area = edges.groupBy(polygon).agg(F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")).alias("_twice"))
    turned = F.col("_twice") < 0
    ends = {a: F.when(turned, F.col(b)).otherwise(F.col(a)) for a, b in (("x0", "x1"), ("y0", "y1"), ("x1", "x0"), ("y1", "y0"))}
    return edges.join(area, polygon).select(*(c for c in edges.columns if c not in EDGE), *(e.alias(n) for n, e in ends.items()))


def outline(edges: DataFrame, *, group: str) -> DataFrame:
    """(group, x0, y0, x1, y1): the edges of a group's polygons that stay when each edge and its opposite cancel out."""
    first, last = (F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (0, 1))
    ahead = first < last
    keyed = edges.where(first != last).select(group, F.when(ahead, first).otherwise(last).alias("a"), F.when(ahead, last).otherwise(first).alias("b"), F.when(ahead, 1).otherwise(-1).alias("n"))
    left = keyed.groupBy(group, "a", "b").agg(F.sum("n").alias("n")).where("n <> 0")
    side = lambda p, q: F.when(F.col("n") > 0, F.col(p)).otherwise(F.col(q))
    return left.select(group, side("a.x", "b.x").alias("x0"), side("a.y", "b.y").alias("y0"), side("b.x", "a.x").alias("x1"), side("b.y", "a.y").alias("y1"))


def rings(edges: DataFrame, *, group: str) -> DataFrame:
    """(group, ring, pos, x0, y0, x1, y1): the edges of an ``outline`` in order around each ring, from its least corner.

    Where rings touch, the way goes on along the edge that turns most to the left, so parts that only touch in a corner stay apart. ``ring``
    is the number of some edge of it; it only tells rings apart.
    """
    e = stash(edges.select(group, *EDGE), "outline")
    # in strips across the longer side, so that most rings lie in one; the strip is the upper part of the number
    n, wide, high = e.agg(F.count("*"), F.max("x0") - F.min("x0"), F.max("y0") - F.min("y0")).first()
    along = ["x0", "y0"] if (wide or 0) > (high or 0) else ["y0", "x0"]
    strips = max(min(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 1000)), -(-n // STRIP), 1)
    e = stash(e.repartitionByRange(strips, *along).withColumn("id", F.monotonically_increasing_id()), "strips")
    # around a corner, by angle: the ends of edges that come in, seen from there, and the edges that go out
    come = e.select(group, F.col("x1").alias("x"), F.col("y1").alias("y"), F.atan2(F.col("y0") - F.col("y1"), F.col("x0") - F.col("x1")).alias("angle"), F.col("id").alias("came"), F.lit(None).cast("long").alias("goes"))
    go = e.select(group, F.col("x0").alias("x"), F.col("y0").alias("y"), F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")).alias("angle"), F.lit(None).cast("long").alias("came"), F.col("id").alias("goes"))
    at = Window.partitionBy(group, "x", "y")
    before = at.orderBy("angle", F.col("came").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    last = at.orderBy("angle").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    onward = come.unionByName(go).select("came", F.coalesce(F.last("goes", ignorenulls=True).over(before), F.last("goes", ignorenulls=True).over(last)).alias("to"))
    placed = chains(onward.where("came IS NOT NULL AND to IS NOT NULL").select(F.col("came").alias("node"), "to"), block=F.shiftright("node", 33))
    got = stash(e.join(placed.select(F.col("node").alias("id"), F.col("chain").alias("ring"), "pos"), "id"), "rings")
    start = got.groupBy("ring").agg(F.count("*").alias("n"), F.min(F.struct("x0", "y0", "pos")).alias("first"))
    return got.join(start, "ring").select(group, "ring", F.pmod(F.col("pos") - F.col("first.pos"), F.col("n")).alias("pos"), *EDGE)


def ring_measures(edges: DataFrame, *, group: str) -> DataFrame:
    """(group, ring, n, area, length): corners, area (below zero for a hole) and length of each ring."""
    twice = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    return edges.groupBy(group, "ring").agg(F.count("*").alias("n"), (F.sum(twice) / 2).alias("area"), F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("length"))


def straight(edges: DataFrame, *, group: str) -> DataFrame:
    """The same rings without the corners at which they don't turn; positions are still in order, with gaps. A ring's corners are sorted in one task, which may spill."""
    nxt = edges.select("ring", (F.col("pos") + 1).alias("pos"), F.col("x0").alias("bx"), F.col("y0").alias("by"))
    n = edges.groupBy("ring").agg((F.max("pos") + 1).alias("n"))
    prev = nxt.join(n, "ring").select("ring", F.pmod("pos", "n").alias("pos"), "bx", "by")
    turns = (F.col("x0") - F.col("bx")) * (F.col("y1") - F.col("y0")) != (F.col("y0") - F.col("by")) * (F.col("x1") - F.col("x0"))
    corner = stash(edges.join(prev, ["ring", "pos"]).where(turns).select(group, "ring", "pos", "x0", "y0"), "corners")
    w = Window.partitionBy("ring").orderBy("pos")
    after = F.coalesce(F.lead(F.struct("x0", "y0")).over(w), F.first(F.struct("x0", "y0")).over(w))
    return corner.withColumn("_to", after).select(group, "ring", "pos", "x0", "y0", F.col("_to.x0").alias("x1"), F.col("_to.y0").alias("y1"))


def holes_of(edges: DataFrame, *, group: str, bucket: float) -> DataFrame:
    """(group, ring, hole): the outer ring that each hole lies in, the least one where they are nested."""
    size = stash(ring_measures(edges, group=group), "sizes")
    hole = edges.where("pos = 0").join(size.where("area < 0").select("ring"), "ring", "left_semi")
    # just to the left of the hole's first edge is the polygon
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    near = hole.select(F.col("ring").alias("hole"), F.col(group).alias("_group"), ((F.col("x0") + F.col("x1")) / 2 - dy * 1e-6).alias("x"), ((F.col("y0") + F.col("y1")) / 2 + dx * 1e-6).alias("y"))
    outer = size.where("area > 0").select("ring", F.col(group).alias("_of"), "area")
    met = points_in_polygons(near, edges.join(outer.select("ring"), "ring", "left_semi"), point="hole", polygon="ring", bucket=bucket)
    own = met.join(near.select("hole", "_group"), "hole").join(outer, "ring").where("_group = _of")
    return own.groupBy(F.col("_group").alias(group), "hole").agg(F.min(F.struct("area", "ring")).alias("m")).select(group, F.col("m.ring").alias("ring"), "hole")


def contour_lines(cells: DataFrame, *, levels: list[float]) -> DataFrame:
    """(level, line, closed, pos, x0, y0, x1, y1): the pieces of contours between cell centres, in order along each line, the higher side always on one hand.

    Two pieces meet where they cross the same side between two centres, which is told by the side, not by the crossing's coordinates. Of the two pieces
    of a saddle one joins the crossings above and to the right, the other those below and to the left.
    """
    near = {"a": (0, 0), "b": (0, 1), "d": (1, 1), "e": (1, 0)}
    sent = cells.select("r", "c", "v", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for n, (dr, dc) in near.items()])).alias("o"))
    sent = sent.select((F.col("r") - F.col("o.dr")).alias("r"), (F.col("c") - F.col("o.dc")).alias("c"), F.col("o.n").alias("n"), "v")
    square = sent.groupBy("r", "c").agg(*[F.max(F.when(F.col("n") == n, F.col("v"))).alias(n) for n in near], F.count("*").alias("k")).where("k = 4")
    at = square.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    level, r, c = F.col("level"), F.col("r"), F.col("c")

    def side(p: str, q: str, down: int, row: int, col: int):
        """Where the level is crossed between the corners p and q, from there going around the square, if it is; ``up`` if q is the higher one."""
        part = (level - F.col(p)) / (F.col(q) - F.col(p))
        # corners of the later two sides stand in the other direction of their axis
        part = F.lit(1.0) - part if (p, q) in (("d", "e"), ("e", "a")) else part
        x = c + col + (F.lit(0.0) if down else part)
        y = r + row + (part if down else F.lit(0.0))
        return F.when((F.col(p) < level) != (F.col(q) < level), F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), (F.col(q) >= level).alias("up"), F.struct(F.lit(down).alias("down"), (r + row).alias("row"), (c + col).alias("col")).alias("key")))

    sides = F.array_compact(F.array(side("a", "b", 0, 0, 0), side("b", "d", 1, 0, 1), side("d", "e", 0, 1, 0), side("e", "a", 1, 0, 0)))
    each = at.select("level", sides.alias("s")).where(F.size("s") >= 2)
    two = F.when(F.size("s") == 4, F.array(F.slice("s", 1, 2), F.slice("s", 3, 2))).otherwise(F.array(F.slice("s", 1, 2)))
    pair = each.select("level", F.explode(two).alias("p"))
    # going around the square a piece has one crossing upwards and one downwards; it leads from that upwards to the other
    got = pair.select("level", *(F.when(F.col("p")[0]["up"], F.col("p")[i]).otherwise(F.col("p")[1 - i]).alias(n) for i, n in ((0, "f"), (1, "t"))))
    pieces = stash(got.select("level", F.col("f.x").alias("x0"), F.col("f.y").alias("y0"), F.col("t.x").alias("x1"), F.col("t.y").alias("y1"), F.col("f.key").alias("f"), F.col("t.key").alias("t")).withColumn("id", F.monotonically_increasing_id()), "pieces")
    links = pieces.select("level", F.col("t").alias("k"), F.col("id").alias("node")).join(pieces.select("level", F.col("f").alias("k"), F.col("id").alias("to")), ["level", "k"])
    placed = stash(chains(links.select("node", "to")), "placed")
    lines = pieces.join(placed.withColumnRenamed("node", "id"), "id", "left")
    return lines.select("level", F.coalesce("chain", "id").alias("line"), F.coalesce("ring", F.lit(False)).alias("closed"), F.coalesce("pos", F.lit(0)).cast("long").alias("pos"), *EDGE)


def vertices(lines: DataFrame, *, keep: list[str]) -> DataFrame:
    """(*keep, line, pos, x, y): the points of lines given as edges in order; a closed line ends at its first point again."""
    n = lines.groupBy("line").agg(F.max("pos").alias("_last"))
    last = lines.join(n, "line").where("pos = _last").select(*keep, "line", (F.col("pos") + 1).alias("pos"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    return lines.select(*keep, "line", "pos", F.col("x0").alias("x"), F.col("y0").alias("y")).unionByName(last)


def simplified(points: DataFrame, *, tolerance: float, line: str = "line") -> DataFrame:
    """The rows of ``points`` (line, pos, x, y) that stay when points within the tolerance of the line through what stays are left out (Douglas and Peucker).

    It runs by levels: of every stretch of every line the farthest point is found at once, the earlier one on ties, and where it lies beyond the tolerance the stretch is split
    there. So there are as many rounds as splits lie within each other, most often the logarithm of a line's points.
    """
    pts = stash(points.select(line, "pos", "x", "y"), "points")
    ends = pts.groupBy(line).agg(F.min(F.struct("pos", "x", "y")).alias("a"), F.max(F.struct("pos", "x", "y")).alias("b"))
    kept = ends.select(line, F.explode(F.array_distinct(F.array("a.pos", "b.pos"))).alias("pos"))
    left = stash(pts.join(ends, line).where("pos > a.pos AND pos < b.pos"), "left")
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("a.x")) * dx + (F.col("y") - F.col("a.y")) * dy) / size))).otherwise(0.0)
    far = F.hypot(F.col("x") - F.col("a.x") - t * dx, F.col("y") - F.col("a.y") - t * dy)
    while True:
        top = left.groupBy(line, F.col("a.pos").alias("lo")).agg(F.max(F.struct(far.alias("far"), (-F.col("pos")).alias("back"), "x", "y")).alias("m"))
        split = stash(top.where(F.col("m.far") > tolerance).select(line, "lo", F.struct((-F.col("m.back")).alias("pos"), F.col("m.x").alias("x"), F.col("m.y").alias("y")).alias("s")), "split")
        if split.isEmpty():
            return points.join(kept, [line, "pos"], "left_semi")
        kept = kept.unionByName(split.select(line, "s.pos"))
        go = left.withColumn("lo", F.col("a.pos")).join(split, [line, "lo"]).where("pos <> s.pos")
        before = F.col("pos") < F.col("s.pos")
        left = stash(go.select(line, "pos", "x", "y", F.when(before, F.col("a")).otherwise(F.col("s")).alias("a"), F.when(before, F.col("s")).otherwise(F.col("b")).alias("b")), "left")


def smoothed(cells: DataFrame, *, sigma: float, rows: int, cols: int, reach: float = 4.0) -> DataFrame:
    """(r, c, v): a full grid of ``rows`` by ``cols`` under a Gaussian of that width, rows first and then columns; beyond its rim the grid is mirrored."""
    half = int(reach * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    total = sum(weights)
    kernel = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w / total).alias("w")) for k, w in zip(range(-half, half + 1), weights, strict=True)])

    def along(df: DataFrame, axis: str, n: int) -> DataFrame:
        if half > n:
            raise ValueError("the Gaussian reaches over the whole grid")
        own = F.col(axis)
        spread = df.withColumn("_at", F.explode(F.array(own, -1 - own, 2 * n - 1 - own))).where((F.col("_at") >= -half) & (F.col("_at") < n + half)).withColumn("_k", F.explode(kernel))
        to = (F.col("_at") + F.col("_k.k")).cast("long")
        other = "c" if axis == "r" else "r"
        return spread.select(to.alias(axis), other, (F.col("v") * F.col("_k.w")).alias("v")).where((F.col(axis) >= 0) & (F.col(axis) < n)).groupBy(axis, other).agg(F.sum("v").alias("v"))

    return along(along(cells.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "v"), "r", rows), "c", cols).select("r", "c", "v")


def as_features(edges: DataFrame, *, group: str, bucket: float) -> DataFrame:
    """(group, geometry): a GeoJSON MultiPolygon for each group of ``rings``, every outer ring followed by its holes; a feature's points must fit a row."""
    point = F.array("x0", "y0")
    listed = edges.groupBy(group, "ring").agg(F.array_sort(F.collect_list(F.struct("pos", point.alias("p")))).alias("l")).select(group, "ring", F.transform("l", lambda x: x["p"]).alias("p"))
    closed = stash(listed.select(group, "ring", F.concat("p", F.slice("p", 1, 1)).alias("p")), "closed")
    holes = stash(holes_of(edges, group=group, bucket=bucket), "holes")
    inner = holes.join(closed.select(F.col("ring").alias("hole"), "p"), "hole").groupBy("ring").agg(F.array_sort(F.collect_list("p")).alias("inner"))
    whole = closed.join(holes.select(F.col("hole").alias("ring")), "ring", "left_anti").join(inner, "ring", "left")
    parts = whole.select(group, F.concat(F.array("p"), F.coalesce("inner", F.array().cast("array<array<array<double>>>"))).alias("rings"))
    return parts.groupBy(group).agg(F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array_sort(F.collect_list("rings")).alias("coordinates"))).alias("geometry"))


