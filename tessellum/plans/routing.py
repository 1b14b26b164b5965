"""Queries of routes, on the network of nations and on customers and suppliers as places."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellum.operators import graph as G
from tessellum.operators import routing as R

from .graphs import NET, ROWS, in_rows, net
from .registry import query, table
from .spatial import PTS, points

#: Where the nations lie, in the units of the network's weights.
SEATS = "seats AS (SELECT n_nationkey AS node, (n_nationkey * 37 % 25) * 20.0::DOUBLE AS x, (n_nationkey * 11 % 25) * 20.0::DOUBLE AS y FROM nation)"


def seats(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("node"), (k * 37 % 25 * 20.0).alias("x"), (k * 11 % 25 * 20.0).alias("y"))


@query()
def penalty_routes(spark, sf_dir):
    return R.penalty_alternatives(G.undirected(net(spark, sf_dir)), 0, 9, rounds=6)


@query()
def plateau_routes(spark, sf_dir):
    return R.plateau_routes(G.undirected(net(spark, sf_dir)), 0, 9)


@query(f"""
WITH RECURSIVE {NET}, {SEATS}, stops AS (SELECT *, node AS seq FROM seats WHERE node % 5 = 0), l AS (SELECT row_number() OVER (ORDER BY seq) AS leg, node AS u, lead(node) OVER (ORDER BY seq) AS v, x AS x0, y AS y0, lead(x) OVER (ORDER BY seq) AS x1, lead(y) OVER (ORDER BY seq) AS y1 FROM stops),
p AS (SELECT node AS source, node, 0 AS d FROM stops UNION SELECT p.source, net.v, p.d + w FROM p JOIN net ON net.u = p.node WHERE p.d + w < 500),
m AS (SELECT leg, u, v, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS straight, (SELECT CAST(min(d) AS DOUBLE) FROM p WHERE source = u AND node = v) AS path FROM l WHERE v IS NOT NULL)
SELECT CAST(leg AS INTEGER) AS leg, u, v, round(straight, 4) AS straight, path, path IS NULL OR (straight > 100 AND path > 0.8 * straight) AS flagged,
 round(CASE WHEN path IS NULL OR (straight > 100 AND path > 0.8 * straight) THEN straight ELSE path END, 4) AS length FROM m
""")
def waypoint_legs(spark, sf_dir):
    stops = seats(spark, sf_dir).where("node % 5 = 0").withColumn("seq", F.col("node"))
    got = R.legs(net(spark, sf_dir), stops, detour=0.8, over=100.0)
    return got.withColumn("straight", F.round("straight", 4)).withColumn("length", F.round("length", 4))


@query(f"""
WITH RECURSIVE {NET}, own AS (SELECT u, v, w FROM net WHERE (u * v) % 3 = 0 UNION ALL SELECT v, u, w FROM net WHERE (u * v) % 3 = 0), p AS (SELECT 0 AS node, 0 AS d UNION SELECT own.v, p.d + w FROM p JOIN own ON own.u = p.node WHERE p.d + w < 400)
SELECT CAST(node AS BIGINT) AS node, CAST(min(d) AS DOUBLE) AS dist FROM p GROUP BY node
""")
def along_number(spark, sf_dir):
    refs = F.when(F.col("u") * F.col("v") % 3 == 0, F.array(F.lit("42"), F.lit("7"))).otherwise(F.array(F.lit("7")))
    return R.along_number(net(spark, sf_dir).withColumn("refs", refs), "42", 0, cutoff=399.5)


@query(f"WITH {ROWS}, b AS (SELECT u AS x, v AS y FROM rows WHERE (u + v) % 2 = 1 UNION SELECT v, u FROM rows WHERE (u + v) % 2 = 1) SELECT CAST(x AS BIGINT) AS node FROM b GROUP BY x HAVING count(*) = 1")
def number_ends(spark, sf_dir):
    refs = F.when((F.col("u") + F.col("v")) % 2 == 1, F.array(F.lit("42"))).otherwise(F.array(F.lit("7")))
    return R.number_ends(in_rows(spark, sf_dir).withColumn("refs", refs), "42")


@query(f"""
WITH {ROWS}, {SEATS}, d AS (SELECT node FROM (SELECT u AS node FROM rows UNION ALL SELECT v FROM rows) GROUP BY node HAVING count(*) = 1),
m AS (SELECT a.node AS u, b.node AS v, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS w FROM d JOIN seats a USING (node) JOIN seats b ON a.node <> b.node WHERE NOT EXISTS (SELECT 1 FROM rows r WHERE (r.u = a.node AND r.v = b.node) OR (r.v = a.node AND r.u = b.node))),
k AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY w, v) AS k FROM m WHERE w <= 120) SELECT CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v, round(w, 4) AS w FROM k WHERE k = 1
""")
def tied_ends(spark, sf_dir):
    return R.tied_ends(in_rows(spark, sf_dir), seats(spark, sf_dir), within_m=120.0).withColumn("w", F.round("w", 4))


@query(f"""
WITH RECURSIVE {NET}, {PTS}, pl AS (SELECT id, id % 25 AS node, x, y, (id % 80)::DOUBLE AS d FROM pts), t AS (SELECT id AS t, node AS tn, d AS td, x, y FROM pl WHERE id % 10 = 0 AND d <= 60),
p AS (SELECT tn AS source, tn AS node, 0 AS d FROM (SELECT DISTINCT tn FROM t) UNION SELECT p.source, net.u, p.d + w FROM p JOIN net ON net.v = p.node WHERE p.d + w <= 400), n AS (SELECT source, node, min(d) AS way FROM p GROUP BY 1, 2),
r AS (SELECT pl.id, (pl.d + way + td) / sqrt((pl.x - t.x) ** 2 + (pl.y - t.y) ** 2) AS r FROM pl JOIN t ON sqrt((pl.x - t.x) ** 2 + (pl.y - t.y) ** 2) BETWEEN 150 AND 800 AND pl.id <> t.t JOIN n ON source = tn AND n.node = pl.node WHERE pl.d <= 60),
g AS (SELECT id, count(*) AS n, median(r) AS m FROM r GROUP BY id)
SELECT pl.id, coalesce(n, 0) AS n, round(CASE WHEN d > 60 THEN NULL WHEN coalesce(n, 0) < 8 THEN -1.0::DOUBLE ELSE m END, 6) AS directness FROM pl LEFT JOIN g USING (id)
""")
def directness(spark, sf_dir):
    pl = points(spark, sf_dir).select("id", (F.col("id") % 25).alias("node"), "x", "y", (F.col("id") % 80).cast("double").alias("d"))
    return R.directness(pl, pl.where("id % 10 = 0"), net(spark, sf_dir), cutoff=400.0).withColumn("directness", F.round("directness", 6))


@query(f"""
WITH RECURSIVE {NET}, {SEATS}, p AS (SELECT 3 AS node, 0 AS d UNION SELECT net.v, p.d + w FROM p JOIN net ON net.u = p.node WHERE p.d + w <= 300), n AS (SELECT node, min(d) AS d FROM p GROUP BY node),
o AS (SELECT CAST(floor(y / 100) AS BIGINT) AS r, CAST(floor(x / 100) AS BIGINT) AS c, CAST(min(d) AS DOUBLE) AS t FROM n JOIN seats USING (node) GROUP BY 1, 2), k AS (SELECT a, b FROM generate_series(-1, 1) x(a), generate_series(-1, 1) y(b) WHERE a * a + b * b <= 1)
SELECT r + a AS r, c + b AS c, min(t) AS t FROM o, k GROUP BY 1, 2
""")
def isochrone(spark, sf_dir):
    return R.isochrone(net(spark, sf_dir), seats(spark, sf_dir), 3, limit=300.0, cell=100.0, reach=1)


@query(f"""
WITH RECURSIVE {NET}, open AS (SELECT * FROM net WHERE (u * 7 + v) % 4 <> 0), p AS (SELECT 0 AS node UNION SELECT open.v FROM p JOIN open ON open.u = p.node), k AS (SELECT c_nationkey AS node, count(*) AS n FROM customer GROUP BY 1)
SELECT count(*) AS vertices, CAST(sum(n) AS BIGINT) AS people FROM p LEFT JOIN k USING (node)
""")
def reach_after_closures(spark, sf_dir):
    n = net(spark, sf_dir)
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("node")).agg(F.count("*").alias("n"))
    return R.reach_after(n, people, 0, n.where("(u * 7 + v) % 4 = 0"))


#: The tied rows of nations in both directions.
BOTH = f"{ROWS}, bw AS (SELECT u, v, w FROM rows UNION ALL SELECT v, u, w FROM rows)"


def both_ways(spark, sf_dir):
    return G.undirected(in_rows(spark, sf_dir))


@query(f"""
WITH RECURSIVE {BOTH}, p AS (SELECT 100 AS node, 0 AS d UNION SELECT bw.v, p.d + w FROM p JOIN bw ON bw.u = p.node WHERE p.d + w < 1500), t AS (SELECT node, min(d) AS d FROM p GROUP BY node),
up AS (SELECT b.node, min(a.node) AS via FROM t b JOIN bw ON bw.v = b.node JOIN t a ON a.node = bw.u AND a.d + w = b.d WHERE b.node <> 100 GROUP BY b.node),
walk AS (SELECT node, node AS here, false AS crosses, node AS first FROM t WHERE d > 120 UNION ALL SELECT walk.node, up.via, walk.crosses OR (least(here, via) + greatest(here, via)) % 5 = 0, here FROM walk JOIN up ON up.node = walk.here)
SELECT CAST(node AS BIGINT) AS node, CAST(first AS BIGINT) AS first, crosses FROM walk WHERE here = 100
""")
def route_exits(spark, sf_dir):
    n = both_ways(spark, sf_dir)
    return R.exits(n, 100, F.col("dist") > 120, n.where("(u + v) % 5 = 0"))


@query(f"""
WITH {NET}, r AS (SELECT u % 4 AS route, least(u, v) AS u, greatest(u, v) AS v FROM net) SELECT CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v, count(DISTINCT route) AS uses FROM r GROUP BY 1, 2
""")
def edge_usage(spark, sf_dir):
    return R.usage(net(spark, sf_dir).select((F.col("u") % 4).alias("route"), "u", "v"))


@query(f"""
WITH RECURSIVE {ROWS}, pieces AS (SELECT * FROM rows), w AS (SELECT c_nationkey AS node, count(*) AS n FROM customer GROUP BY 1), both_ways AS (SELECT u AS x, v AS y, u AS eu, v AS ev FROM rows UNION ALL SELECT v, u, u, v FROM rows),
r AS (SELECT u AS eu, v AS ev, 100 AS node FROM rows UNION SELECT r.eu, r.ev, b.y FROM r JOIN both_ways b ON b.x = r.node AND NOT (b.eu = r.eu AND b.ev = r.ev)), a AS (SELECT DISTINCT u AS node FROM rows UNION SELECT v FROM rows)
SELECT CAST(least(eu, ev) AS BIGINT) AS u, CAST(greatest(eu, ev) AS BIGINT) AS v, CAST(coalesce(sum(n), 0) AS DOUBLE) AS beyond FROM (SELECT e.u AS eu, e.v AS ev, a.node FROM rows e, a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.eu = e.u AND r.ev = e.v AND r.node = a.node)) LEFT JOIN w USING (node) GROUP BY 1, 2
""")
def cut_edges(spark, sf_dir):
    """Bridges on the tied rows of nations, with the customers beyond each."""
    weights = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("node")).agg(F.count("*").alias("weight"))
    return G.bridges(in_rows(spark, sf_dir), weights, root=100)


@query(f"""
WITH RECURSIVE {BOTH}, f AS (SELECT 100 AS node, 0 AS d UNION SELECT bw.v, f.d + w FROM f JOIN bw ON bw.u = f.node WHERE f.d + w < 1500), df AS (SELECT node, min(d) AS d FROM f GROUP BY node),
b AS (SELECT 104 AS node, 0 AS d UNION SELECT bw.u, b.d + w FROM b JOIN bw ON bw.v = b.node WHERE b.d + w < 1500), db AS (SELECT node, min(d) AS d FROM b GROUP BY node)
SELECT CAST(bw.u AS BIGINT) AS u, CAST(bw.v AS BIGINT) AS v, CAST(fu.d + w + bv.d AS DOUBLE) AS via FROM bw JOIN df fu ON fu.node = bw.u JOIN df fv ON fv.node = bw.v JOIN db bu ON bu.node = bw.u JOIN db bv ON bv.node = bw.v
WHERE fu.d + w = fv.d AND bv.d + w = bu.d AND fu.d + w + bv.d <= 1.5 * (SELECT d FROM df WHERE node = 104)
""")
def plateau_edge_lengths(spark, sf_dir):
    return G.plateaus(both_ways(spark, sf_dir), start=100, end=104)
