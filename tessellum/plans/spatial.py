"""Queries of spatial joins, on points made of account balances and sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellum.functions import geo
from tessellum.operators import spatial as S
from tessellum.operators.vectors import nearest_vectors

from .registry import query, table

PTS = "pts AS (SELECT c_custkey AS id, c_acctbal AS x, (c_custkey * 37 % 1000)::DOUBLE AS y FROM customer)"
SUP = "sup AS (SELECT s_suppkey AS sid, s_acctbal AS x, (s_suppkey * 53 % 1000)::DOUBLE AS y FROM supplier)"
RINGS = {1: [(0, 0), (4000, 100), (3000, 900), (500, 700)], 2: [(3500, 200), (9000, 50), (8000, 950), (6000, 400), (4000, 800)], 3: [(-900, 100), (2000, 300), (1000, 600)]}
EDGES = "edges AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {a[0]}.0::DOUBLE, {a[1]}.0::DOUBLE, {b[0]}.0::DOUBLE, {b[1]}.0::DOUBLE)" for k, r in RINGS.items() for a, b in zip(r, r[1:] + r[:1], strict=True)) + ") t(zone, x0, y0, x1, y1))"


def points(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 37 % 1000).cast("double").alias("y"))


def places(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sid"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") * 53 % 1000).cast("double").alias("y"))


def zones(spark):
    rows = [(k, [(float(x), float(y)) for x, y in r]) for k, r in RINGS.items()]
    return S.edges_of(spark.createDataFrame(rows, "zone int, ring array<struct<x double, y double>>"), ring="ring", keep=["zone"])


INSIDE = f"""{PTS}, {EDGES}, inside AS (SELECT id, zone FROM pts JOIN edges ON (y0 > y) <> (y1 > y) AND x < (x1 - x0) * (y - y0) / (y1 - y0) + x0 GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""


#: The corners of a supplier's shape, in its half widths and heights around its place.
CORNERS = [(-1.0, -1.0), (1.0, -0.5), (0.8, 0.9), (0.0, 0.4), (-0.7, 1.0)]
SHAPES = "corners AS (SELECT s_suppkey AS zone, i, s_acctbal + dx * (20 + s_suppkey % 7 * 10) AS x, (s_suppkey * 53 % 1000) + dy * (15 + s_suppkey % 5 * 8) AS y FROM supplier, (VALUES " + ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(CORNERS)) + ") t(i, dx, dy)), edges AS (SELECT a.zone, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM corners a JOIN corners b ON a.zone = b.zone AND b.i = (a.i + 1) % 5)"


def shapes(spark, sf_dir):
    """Edges of a five-cornered shape around each supplier."""
    k = F.col("s_suppkey")
    ring = F.array(*[F.struct((F.col("s_acctbal") + dx * (20 + k % 7 * 10)).alias("x"), (k * 53 % 1000 + dy * (15 + k % 5 * 8)).alias("y")) for dx, dy in CORNERS])
    return S.edges_of(table(spark, sf_dir, "supplier").select(k.alias("zone"), ring.alias("ring")), ring="ring", keep=["zone"])


@query(f"WITH {INSIDE} SELECT id, CAST(zone AS INTEGER) AS zone FROM inside")
def pip_join(spark, sf_dir):
    return S.points_in_polygons(points(spark, sf_dir), zones(spark), point="id", polygon="zone", bucket=50.0)


@query(f"WITH {INSIDE} SELECT pts.id, CAST(coalesce(max(zone), 0) AS INTEGER) AS rank, CAST(coalesce(min(zone), 0) AS INTEGER) AS first, CAST(coalesce(bit_or(1 << (zone - 1)), 0) AS INTEGER) AS kinds FROM pts LEFT JOIN inside USING (id) GROUP BY pts.id")
def pip_rank(spark, sf_dir):
    p = points(spark, sf_dir)
    hit = S.points_in_polygons(p, zones(spark), point="id", polygon="zone", bucket=50.0)
    bit = F.pow(F.lit(2), F.col("zone") - 1).cast("int")
    got = hit.groupBy("id").agg(F.max("zone").alias("rank"), F.min("zone").alias("first"), F.bit_or(bit).alias("kinds"))
    return p.select("id").join(got, "id", "left").na.fill(0, ["rank", "first", "kinds"])


@query(f"WITH {INSIDE} SELECT CAST(zone AS INTEGER) AS zone, count(*) AS n, round(100.0 * count(*) FILTER (x >= 2000) / count(*), 4) AS deep_share FROM inside JOIN pts USING (id) GROUP BY zone")
def zone_shares(spark, sf_dir):
    p = points(spark, sf_dir)
    hit = S.points_in_polygons(p, zones(spark), point="id", polygon="zone", bucket=50.0).join(p, "id")
    return hit.groupBy("zone").agg(F.count("*").alias("n"), F.round(100 * F.count_if(F.col("x") >= 2000) / F.count("*"), 4).alias("deep_share"))


@query(f"WITH {SHAPES} SELECT zone, round(abs(sum(x0 * y1 - x1 * y0)) / 2, 4) AS area, round(sum(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)), 4) AS length FROM edges GROUP BY zone")
def polygon_measures(spark, sf_dir):
    return S.polygon_measures(shapes(spark, sf_dir), polygon="zone").select("zone", F.round("area", 4).alias("area"), F.round("length", 4).alias("length"))


@query(f"WITH {PTS}, {SUP} SELECT id, sid, round(sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2), 6) AS dist FROM pts p JOIN sup s ON sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) <= 200")
def radius_join(spark, sf_dir):
    return S.within(points(spark, sf_dir), places(spark, sf_dir), lid="id", rid="sid", radius=200.0, fine=3).select("id", "sid", F.round("dist", 6).alias("dist"))


@query(f"""WITH {PTS}, {SUP}, d AS (SELECT id, sid, sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) AS dist FROM pts p, sup s), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, sid) AS k FROM d)
SELECT id, sid, round(dist, 6) AS dist FROM r WHERE k = 1""")
def nearest_join(spark, sf_dir):
    return S.nearest(points(spark, sf_dir), places(spark, sf_dir), lid="id", rid="sid", size=300.0).select("id", "sid", F.round("dist", 6).alias("dist"))


@query(f"""WITH {PTS}, {SUP}, h AS (SELECT p.id, count(*) AS n FROM pts p JOIN sup s ON sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) <= 150 GROUP BY 1)
SELECT pts.id, coalesce(n, 0) AS n, n IS NOT NULL AS any_near FROM pts LEFT JOIN h USING (id)""")
def radius_count(spark, sf_dir):
    p = points(spark, sf_dir)
    at = F.struct("x", "y")
    # what stands at one place is counted once, with its number
    s = places(spark, sf_dir).groupBy("x", "y").agg(F.count("*").alias("n"))
    n = S.within(p.select(at.alias("at"), "x", "y").distinct(), s, lid="at", rid="n", radius=150.0, fine=3).groupBy("at").agg(F.sum("n").alias("k"))
    return p.select("id", at.alias("at")).join(n, "at", "left").select("id", F.coalesce("k", F.lit(0)).alias("n"), F.col("k").isNotNull().alias("any_near"))


CELLS = "cells AS (SELECT (p_partkey % 40) AS r, (p_partkey // 40 % 40) AS c, max(p_size)::DOUBLE AS v FROM part WHERE p_brand <> 'Brand#1' GROUP BY 1, 2)"


def cells(spark, sf_dir):
    df = table(spark, sf_dir, "part").where("p_brand <> 'Brand#1'")
    return df.groupBy((F.col("p_partkey") % 40).alias("r"), (F.floor(F.col("p_partkey") / 40) % 40).alias("c")).agg(F.max("p_size").cast("double").alias("v"))


@query(f"WITH {PTS}, {CELLS} SELECT id, coalesce(v, 0) AS v FROM (SELECT id, CAST(floor((40 - y / 20)) AS BIGINT) AS r, CAST(floor(x / 250) AS BIGINT) AS c FROM pts) LEFT JOIN cells USING (r, c)")
def raster_lookup(spark, sf_dir):
    p = points(spark, sf_dir).select("id", (F.col("x") / 250).alias("x"), (F.col("y") / 20).alias("y"))
    return S.raster_lookup(p, cells(spark, sf_dir), east=0.0, north=40.0, outside=0.0).select("id", "v")


@query(f"""WITH {PTS}, {CELLS}, q AS (SELECT id, x / 250 - 0.5 AS fx, y / 25 - 0.5 AS fy FROM pts), o AS (SELECT id, fx, fy, CAST(floor(fx) AS BIGINT) + a AS c, CAST(floor(fy) AS BIGINT) + b AS r FROM q, (VALUES (0), (1)) s(a), (VALUES (0), (1)) t(b))
SELECT id, CASE WHEN count(v) = 4 THEN round(sum((1 - abs(fx - c)) * (1 - abs(fy - r)) * v), 6) END AS v FROM o LEFT JOIN cells USING (r, c) GROUP BY id""")
def bilinear_sample(spark, sf_dir):
    p = points(spark, sf_dir).select("id", (F.col("x") / 250).alias("x"), (F.col("y") / 25).alias("y"))
    return S.bilinear(p, cells(spark, sf_dir), pid="id").select("id", F.round("v", 6).alias("v"))


@query(f"""WITH {CELLS}, k AS (SELECT r, c, CASE WHEN v > 20 THEN v END AS v FROM cells)
SELECT a.r, a.c, coalesce(a.v, min(b.v)) AS filled FROM k a LEFT JOIN k b ON abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 GROUP BY a.r, a.c, a.v""")
def neighbourhood_fallback(spark, sf_dir):
    k = cells(spark, sf_dir).withColumn("v", F.when(F.col("v") > 20, F.col("v")))
    return S.neighbourhood(k, reach=2).select("r", "c", "filled")


@query(f"""WITH {CELLS} SELECT o.r, o.c, round(degrees(atan(sqrt(((e.v - w.v) / 2) ** 2 + ((n.v - s.v) / 2) ** 2))), 6) AS slope FROM cells o
JOIN cells n ON n.r = o.r - 1 AND n.c = o.c JOIN cells s ON s.r = o.r + 1 AND s.c = o.c JOIN cells e ON e.r = o.r AND e.c = o.c + 1 JOIN cells w ON w.r = o.r AND w.c = o.c - 1""")
def slope_grid(spark, sf_dir):
    return S.slope(cells(spark, sf_dir)).select("r", "c", F.round("slope", 6).alias("slope"))


@query(f"""WITH {PTS} SELECT id, round(2 * 6371 * asin(sqrt(power(sin(radians(y / 20 - 25) / 2), 2) + cos(radians(25.0)) * cos(radians(y / 20)) * power(sin(radians(x / 100 - 121) / 2), 2))), 5) AS km,
 CAST(floor((x / 100 + 180) / 360 * 4096) AS BIGINT) AS tx, CAST(floor((1 - ln(tan(radians(y / 20)) + 1 / cos(radians(y / 20))) / pi()) / 2 * 4096) AS BIGINT) AS ty FROM pts""")
def distances_and_tiles(spark, sf_dir):
    lon, lat = F.col("x") / 100, F.col("y") / 20
    tx, ty = geo.tile_xy(lon, lat, 12)
    return points(spark, sf_dir).select("id", F.round(geo.haversine(F.lit(121.0), F.lit(25.0), lon, lat), 5).alias("km"), tx.alias("tx"), ty.alias("ty"))


@query("""WITH p AS (SELECT c_custkey AS id, 135 + (c_custkey % 97) / 97.0::DOUBLE AS lon, 33 + (c_custkey % 89) / 89.0::DOUBLE AS lat FROM customer),
a AS (SELECT id, floor(lat * 1.5) AS p, lat * 1.5 - floor(lat * 1.5) AS fa, floor(lon - 100) AS u, lon - 100 - floor(lon - 100) AS fb FROM p),
b AS (SELECT id, p, u, floor(fa * 8) AS q, fa * 8 - floor(fa * 8) AS ga, floor(fb * 8) AS v, fb * 8 - floor(fb * 8) AS gb FROM a),
c AS (SELECT *, floor(ga * 10) AS r, ga * 10 - floor(ga * 10) AS ha, floor(gb * 10) AS w, gb * 10 - floor(gb * 10) AS hb FROM b),
d AS (SELECT *, floor(ha * 2) * 2 + floor(hb * 2) + 1 AS m, ha * 2 - floor(ha * 2) AS ia, hb * 2 - floor(hb * 2) AS ib FROM c)
SELECT id, concat(CAST(p AS INT), CAST(u AS INT), CAST(q AS INT), CAST(v AS INT), CAST(r AS INT), CAST(w AS INT), CAST(m AS INT), CAST(floor(ia * 2) * 2 + floor(ib * 2) + 1 AS INT)) AS code FROM d""")
def mesh_codes(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), geo.mesh_code(F.lit(135) + (k % 97) / F.lit(97.0), F.lit(33) + (k % 89) / F.lit(89.0)).alias("code"))


@query(f"WITH {PTS} SELECT round(regr_slope(t, x), 8) AS slope_x FROM (SELECT x, 3 * x + 7 AS t FROM pts)")
def affine_line(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("t", 3 * F.col("x") + 7 + 0 * F.col("y"))
    return S.affine_fit(p, x="x", y="y", target="t").select(F.round("a", 8).alias("slope_x"))


@query(f"""
WITH {PTS}, t AS (SELECT x, y, 2 * x - 3 * y + 5 + id % 7 AS t FROM pts), m AS (SELECT covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(y, y) AS yy, covar_pop(x, t) AS xt, covar_pop(y, t) AS yt, avg(x) AS mx, avg(y) AS my, avg(t) AS mt FROM t),
f AS (SELECT *, (xt * yy - yt * xy) / (xx * yy - xy * xy) AS a, (yt * xx - xt * xy) / (xx * yy - xy * xy) AS b FROM m), r AS (SELECT max(abs(t - (a * x + b * y + mt - a * mx - b * my))) AS worst FROM t, f)
SELECT round(a, 6) AS a, round(b, 6) AS b, round(mt - a * mx - b * my, 4) AS c, round(worst, 4) AS worst FROM f, r
""")
def affine_plane(spark, sf_dir):
    """Both coordinates, the constant and the largest residual of the fit."""
    p = points(spark, sf_dir).withColumn("t", 2 * F.col("x") - 3 * F.col("y") + 5 + F.col("id") % 7)
    fit = S.affine_fit(p, x="x", y="y", target="t")
    worst = p.crossJoin(F.broadcast(fit)).groupBy("a", "b", "c").agg(F.max(F.abs(F.col("t") - F.col("a") * F.col("x") - F.col("b") * F.col("y") - F.col("c"))).alias("worst"))
    return worst.select(F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("c", 4).alias("c"), F.round("worst", 4).alias("worst"))


@query("""
WITH a AS (SELECT l_orderkey AS k, l_quantity AS lo, l_quantity + 5 AS hi FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT l_orderkey AS k, l_quantity AS lo, l_quantity + 3 AS hi FROM lineitem WHERE l_linenumber > 3)
SELECT a.k, sum(least(a.hi, b.hi) - greatest(a.lo, b.lo)) AS overlap FROM a JOIN b ON a.k = b.k AND greatest(a.lo, b.lo) < least(a.hi, b.hi) GROUP BY a.k
""")
def interval_overlap(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    one = lambda n, d: df.where(f"l_linenumber {n}").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("lo"), (F.col("l_quantity") + d).alias("hi"))
    return S.interval_overlap(one("<= 3", 5), one("> 3", 3), key="k")


@query("""
WITH d AS (SELECT a.vec_id, b.vec_id AS other, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, other) AS k FROM d) SELECT vec_id, other FROM r WHERE k = 1
""")
def nearest_vector(spark, sf_dir):
    """For each row whose id is divisible by 50, the nearest other vector."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return nearest_vectors(e, e.where("id % 50 = 0")).select(F.col("id").alias("vec_id"), "other")
