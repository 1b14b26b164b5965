"""Queries of outlines, on a grid of parts that grows with the table and on parcels of customers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessellum.operators import rings as R

from .registry import query, table

#: Parts in rows of twenty; the class is a third of their sizes, over stretches of neighbouring parts.
GRID = "grid AS (SELECT p_partkey // 20 AS r, p_partkey % 20 AS c, max(p_size)::DOUBLE AS v FROM part GROUP BY 1, 2), classes AS (SELECT r, c, CAST(floor(v / 17) AS BIGINT) AS kind FROM grid)"
#: Customers on a slanted grid of a hundred columns, with the nation's remainder as zone; each parcel is a ring of four corners.
PARCELS = """own AS (SELECT c_custkey AS id, c_nationkey % 3 AS zone, c_custkey % 100 AS c, c_custkey // 100 AS r FROM customer),
corners AS (SELECT id, zone, k, (c + dx) * 10.0::DOUBLE + (r + dy) * 3 AS x, (r + dy) * 8.0::DOUBLE - (c + dx) * 2 AS y FROM own, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) t(k, dx, dy)),
sides AS (SELECT a.id, a.zone, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM corners a JOIN corners b ON a.id = b.id AND b.k = (a.k + 1) % 4)"""


def grid(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").groupBy(F.floor(k / 20).cast("long").alias("r"), (k % 20).cast("long").alias("c")).agg(F.max("p_size").cast("double").alias("v"))


def classes(spark, sf_dir):
    return grid(spark, sf_dir).select("r", "c", F.floor(F.col("v") / 17).cast("long").alias("kind"))


def parcels(spark, sf_dir):
    """(id, zone, x0, y0, x1, y1); every other parcel turns right."""
    k = F.col("c_custkey")
    own = table(spark, sf_dir, "customer").select(k.alias("id"), (F.col("c_nationkey") % 3).alias("zone"), (k % 100).alias("c"), F.floor(k / 100).alias("r"))
    at = [F.struct(((F.col("c") + dx) * 10.0 + (F.col("r") + dy) * 3).alias("x"), ((F.col("r") + dy) * 8.0 - (F.col("c") + dx) * 2).alias("y")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))]
    sides = F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in zip(at, at[1:] + at[:1], strict=True)])
    e = own.select("id", "zone", F.explode(sides).alias("s"))
    turned = F.col("id") % 2 == 1
    ends = {n: F.when(turned, F.col(f"s.{q}.{z}")).otherwise(F.col(f"s.{p}.{z}")) for n, p, q, z in (("x0", "a", "b", "x"), ("y0", "a", "b", "y"), ("x1", "b", "a", "x"), ("y1", "b", "a", "y"))}
    return e.select("id", "zone", *(v.alias(n) for n, v in ends.items()))


def zone_rings(spark, sf_dir):
    return R.rings(R.outline(R.facing(parcels(spark, sf_dir), polygon="id"), group="zone"), group="zone")


def class_rings(spark, sf_dir):
    return R.rings(R.outline(R.cell_edges(classes(spark, sf_dir), group="kind"), group="kind"), group="kind")


@query(f"""
WITH {GRID}, near AS (SELECT a.kind, (SELECT count(*) FROM classes b WHERE b.kind = a.kind AND abs(a.r - b.r) + abs(a.c - b.c) = 1) AS n FROM classes a)
SELECT kind, CAST(count(*) AS DOUBLE) AS area, CAST(sum(4 - n) AS DOUBLE) AS length FROM near GROUP BY kind
""")
def dissolved_classes(spark, sf_dir):
    """Area and length of the rings around the cells of each class."""
    got = R.ring_measures(class_rings(spark, sf_dir), group="kind")
    return got.groupBy("kind").agg(F.sum("area").alias("area"), F.sum("length").alias("length"))


@query(f"""
WITH {PARCELS}, k AS (SELECT zone, CASE WHEN (x0, y0) < (x1, y1) THEN [x0, y0, x1, y1] ELSE [x1, y1, x0, y0] END AS e FROM sides), rim AS (SELECT zone, e FROM k GROUP BY zone, e HAVING count(*) % 2 = 1),
whole AS (SELECT zone, abs(sum(x0 * y1 - x1 * y0)) / 2 AS area FROM sides GROUP BY zone)
SELECT zone, round(any_value(area), 4) AS area, round(sum(sqrt((e[3] - e[1]) ** 2 + (e[4] - e[2]) ** 2)), 4) AS length, count(*) AS edges FROM rim JOIN whole USING (zone) GROUP BY zone
""")
def dissolved_zones(spark, sf_dir):
    """What is left of the parcels' edges in each zone, and the area within."""
    got = R.ring_measures(zone_rings(spark, sf_dir), group="zone")
    return got.groupBy("zone").agg(F.round(F.sum("area"), 4).alias("area"), F.round(F.sum("length"), 4).alias("length"), F.sum("n").alias("edges"))


@query()
def zone_polygons(spark, sf_dir):
    """Each ring of the dissolved zones by its least corner, with the corners at which it turns, and the least corner of the ring that it is a hole of."""
    rings = R.stash(zone_rings(spark, sf_dir), "zone_rings")
    first = rings.where("pos = 0").select("ring", F.col("x0").alias("x"), F.col("y0").alias("y"))
    size = R.ring_measures(rings, group="zone").join(R.straight(rings, group="zone").groupBy("ring").agg(F.count("*").alias("corners")), "ring")
    holes = R.holes_of(rings, group="zone", bucket=50.0).select(F.col("hole").alias("ring"), F.col("ring").alias("outer"))
    named = size.join(first, "ring").join(holes, "ring", "left").join(first.select(F.col("ring").alias("outer"), F.col("x").alias("outer_x"), F.col("y").alias("outer_y")), "outer", "left")
    return named.select("zone", "x", "y", "n", "corners", F.round("area", 4).alias("area"), "outer_x", "outer_y")


SMOOTH = f"""{GRID}, size AS (SELECT max(r) + 1 AS rows, 20 AS cols FROM grid), w AS (SELECT k, exp(-0.5 * (k / 1.5::DOUBLE) ** 2) / (SELECT sum(exp(-0.5 * (j / 1.5::DOUBLE) ** 2)) FROM generate_series(-6, 6) t(j)) AS w FROM generate_series(-6, 6) s(k)),
full_grid AS (SELECT r, c, coalesce(v, 0) AS v FROM (SELECT r, c FROM size, range((SELECT rows FROM size)) a(r), range(20) b(c)) LEFT JOIN grid USING (r, c)),
one AS (SELECT g.r, g.c, sum(w * o.v) AS v FROM full_grid g, w, size, full_grid o WHERE o.c = g.c AND o.r = CASE WHEN g.r + k < 0 THEN -1 - g.r - k WHEN g.r + k >= rows THEN 2 * rows - 1 - g.r - k ELSE g.r + k END GROUP BY 1, 2),
two AS (SELECT g.r, g.c, sum(w * o.v) AS v FROM one g, w, size, one o WHERE o.r = g.r AND o.c = CASE WHEN g.c + k < 0 THEN -1 - g.c - k WHEN g.c + k >= cols THEN 2 * cols - 1 - g.c - k ELSE g.c + k END GROUP BY 1, 2)"""


def smooth(spark, sf_dir):
    g = grid(spark, sf_dir)
    rows = (g.agg(F.max("r")).first()[0] or 0) + 1
    whole = spark.range(rows * 20).select(F.floor(F.col("id") / 20).alias("r"), (F.col("id") % 20).alias("c")).join(g, ["r", "c"], "left").na.fill(0.0, ["v"])
    return R.smoothed(whole, sigma=1.5, rows=rows, cols=20, reach=4.0)


@query(f"WITH {SMOOTH} SELECT r, c, round(v, 6) AS v FROM two")
def smoothed_grid(spark, sf_dir):
    return smooth(spark, sf_dir).select("r", "c", F.round("v", 6).alias("v"))


#: Levels that no smoothed value meets exactly.
LEVELS = [22.13, 27.71]


def lines(spark, sf_dir):
    return R.contour_lines(R.stash(smooth(spark, sf_dir), "smooth"), levels=LEVELS)


@query(f"""
WITH {SMOOTH}, q AS (SELECT a.r, a.c, a.v AS a, b.v AS b, d.v AS d, e.v AS e FROM two a JOIN two b ON b.r = a.r AND b.c = a.c + 1 JOIN two d ON d.r = a.r + 1 AND d.c = a.c + 1 JOIN two e ON e.r = a.r + 1 AND e.c = a.c), l AS (SELECT *, unnest({LEVELS}::DOUBLE[]) AS level FROM q),
s AS (SELECT level, r, c, list_filter([CASE WHEN (a < level) <> (b < level) THEN [c + (level - a) / (b - a), r, 0, r, c] END, CASE WHEN (b < level) <> (d < level) THEN [c + 1, r + (level - b) / (d - b), 1, r, c + 1] END, CASE WHEN (e < level) <> (d < level) THEN [c + (level - e) / (d - e), r + 1, 0, r + 1, c] END, CASE WHEN (a < level) <> (e < level) THEN [c, r + (level - a) / (e - a), 1, r, c] END], lambda x: x IS NOT NULL) AS s FROM l),
p AS (SELECT level, s[1] AS m, s[2] AS n FROM s WHERE len(s) >= 2 UNION ALL SELECT level, s[3], s[4] FROM s WHERE len(s) = 4),
loose AS (SELECT level, k FROM (SELECT level, m[3:5] AS k FROM p UNION ALL SELECT level, n[3:5] FROM p) GROUP BY level, k HAVING count(*) = 1)
SELECT level, count(*) AS pieces, (SELECT count(*) // 2 FROM loose WHERE loose.level = p.level) AS open_lines, round(sum(sqrt((m[1] - n[1]) ** 2 + (m[2] - n[2]) ** 2)), 4) AS length FROM p GROUP BY level
""")
def joined_contours(spark, sf_dir):
    """Pieces, lines with loose ends and length of the contours at each level."""
    got = lines(spark, sf_dir)
    each = got.groupBy("level", "line").agg(F.count("*").alias("pieces"), F.first("closed").alias("closed"), F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("length"))
    return each.groupBy("level").agg(F.sum("pieces").alias("pieces"), F.count_if(~F.col("closed")).alias("open_lines"), F.round(F.sum("length"), 4).alias("length"))


@query()
def simplified_contours(spark, sf_dir):
    """Contours of a least length, simplified: level, closed, points before and after, and length after."""
    got = R.stash(lines(spark, sf_dir), "lines")
    long = got.groupBy("line").agg(F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("length")).where("length >= 6").select("line")
    points = R.stash(R.vertices(got.join(long, "line", "left_semi"), keep=["level", "closed"]), "vertices")
    left = R.simplified(points, tolerance=0.35)
    w = Window.partitionBy("line").orderBy("pos")
    steps = left.withColumn("d", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    n = points.groupBy("line").agg(F.count("*").alias("n"))
    each = steps.groupBy("level", "closed", "line").agg(F.count("*").alias("kept"), F.round(F.sum("d"), 4).alias("length")).join(n, "line")
    return each.select("level", "closed", "n", "kept", "length")
