"""Queries of lines and profiles: each user's events are a line, ten units a step, with the value as height."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessellum.functions import text as T
from tessellum.functions.rules import first_rule
from tessellum.operators import gate as G
from tessellum.operators import ordered as O
from tessellum.operators import profiles as P

from .gate import ROUTES, legs
from .registry import query, table

LINES = """pts AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS y FROM events), xy AS (SELECT k, i, i * 10.0::DOUBLE AS x, y FROM pts),
st AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS s FROM xy WINDOW w AS (PARTITION BY k ORDER BY i)), line AS (SELECT k, i, x, y, sum(s) OVER (PARTITION BY k ORDER BY i) AS d FROM st),
seg AS (SELECT * FROM (SELECT k, d AS d0, x AS x0, y AS y0, lead(d) OVER w AS d1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM line WINDOW w AS (PARTITION BY k ORDER BY d)) WHERE d1 > d0), size AS (SELECT k, max(d) AS length FROM line GROUP BY k)"""
AT = "(SELECT {0} + ({1} - {0}) * ({2} - d0) / (d1 - d0) FROM seg WHERE seg.k = t.k AND {2} >= d0 AND ({2} < d1 OR ({2} = d1 AND d1 = t.length)))"


def lines(spark, sf_dir):
    w = O.over("user_id", ["ts", "event_id"])
    p = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), (F.row_number().over(w) - 1).alias("i"), F.col("value").alias("y"))
    return P.measured(p.withColumn("x", F.col("i") * 10.0), key="k", order="i")


@query(f"""
WITH {LINES}, t AS (SELECT k, length, unnest(range(0, greatest(1, CAST(floor(length / 400) AS BIGINT)))) AS i, greatest(1, CAST(floor(length / 400) AS BIGINT)) AS n FROM size WHERE length >= 300),
p AS (SELECT k, i, length, (i + 0.5) * length / n AS p, greatest(0, (i + 0.5) * length / n - 50) AS a, least(length, (i + 0.5) * length / n + 50) AS b FROM t),
q AS (SELECT k, i, {AT.format('x0', 'x1', 'p')} AS x, {AT.format('y0', 'y1', 'p')} AS y, {AT.format('x0', 'x1', 'a')} AS ax, {AT.format('y0', 'y1', 'a')} AS ay, {AT.format('x0', 'x1', 'b')} AS ex, {AT.format('y0', 'y1', 'b')} AS ey FROM p t),
g AS (SELECT *, degrees(atan2(-(ey - ay), ex - ax)) AS g FROM q WHERE sqrt((ex - ax) ** 2 + (ey - ay) ** 2) >= 85)
SELECT k, CAST(i AS INTEGER) AS i, round(x, 4) AS x, round(y, 4) AS y, round(CASE WHEN g > 90 THEN g - 180 WHEN g <= -90 THEN g + 180 ELSE g END, 4) AS angle FROM g
""")
def label_anchors(spark, sf_dir):
    got = P.label_anchors(lines(spark, sf_dir), key="k", spacing=400.0, least=300.0, half=50.0)
    return got.select("k", "i", *[F.round(c, 4).alias(c) for c in ("x", "y", "angle")])


@query(f"""
WITH {LINES}, c AS (SELECT k, length, greatest(1, CAST(ceil(length / 150) AS BIGINT)) AS n FROM size WHERE length > 0), t AS (SELECT *, unnest(range(0, n)) AS piece FROM c), p AS (SELECT k, piece, piece * length / n AS a, (piece + 1) * length / n AS b FROM t),
m AS (SELECT p.k, piece, least(d1, b) - greatest(d0, a) AS w, 2 * atan2(x1 - x0, y1 - y0) AS g FROM p JOIN seg ON seg.k = p.k WHERE least(d1, b) - greatest(d0, a) > 1e-9)
SELECT k, CAST(piece AS INTEGER) AS piece, round((degrees(atan2(sum(w * sin(g)), sum(w * cos(g)))) / 2 + 180) % 180, 4) AS direction, round(sum(w), 4) AS length FROM m GROUP BY k, piece
""")
def line_pieces(spark, sf_dir):
    return P.pieces(lines(spark, sf_dir), key="k", most=150.0).select("k", "piece", F.round("direction", 4).alias("direction"), F.round("length", 4).alias("length"))


@query(f"""
WITH {LINES}, p AS (SELECT s_suppkey AS id, (s_suppkey * 53 % 1000)::DOUBLE AS px, s_acctbal / 100 AS py FROM supplier), m AS (SELECT id, d0, d1, x0, y0, x1, y1, px, py, greatest(0, least(1, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) AS f FROM p, seg WHERE seg.k = 8),
o AS (SELECT id, sqrt((px - x0 - (x1 - x0) * f) ** 2 + (py - y0 - (y1 - y0) * f) ** 2) AS off, d0 + (d1 - d0) * f AS along FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY off, along) AS k FROM o), b AS (SELECT * FROM r WHERE k = 1 AND off <= 30)
SELECT id, round(along, 4) AS along, round(off, 4) AS off, row_number() OVER (ORDER BY along, id) AS place FROM b
""")
def markers_along(spark, sf_dir):
    """Places within 30 of a line, in its order."""
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 53 % 1000).cast("double").alias("x"), (F.col("s_acctbal") / 100).alias("y"))
    near = P.along_and_off(p, lines(spark, sf_dir).where("k = 8"), place="id", key="k", reach=30.0)
    return near.select("id", F.round("along", 4).alias("along"), F.round("off", 4).alias("off"), F.row_number().over(Window.orderBy("along", "id")).cast("long").alias("place"))


@query(f"""
WITH {LINES}, f AS (SELECT i, x AS fy, y AS fx FROM line WHERE k = 8), n AS (SELECT *, coalesce(lead(fx) OVER (ORDER BY i), fx) - coalesce(lag(fx) OVER (ORDER BY i), fx) AS dx, coalesce(lead(fy) OVER (ORDER BY i), fy) - coalesce(lag(fy) OVER (ORDER BY i), fy) AS dy FROM f),
p AS (SELECT s_suppkey AS id, s_acctbal / 100 AS x, (s_suppkey * 53 % 1000)::DOUBLE AS y FROM supplier), m AS (SELECT id, y, sqrt((x - fx) ** 2 + (y - fy) ** 2) AS d, i, ((x - fx) * dy - (y - fy) * dx) / sqrt(dx * dx + dy * dy) AS off FROM p, n),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, i) AS k FROM m) SELECT id, round(off, 4) AS "offset", y BETWEEN (SELECT min(fy) FROM f) - 5 AND (SELECT max(fy) FROM f) + 5 AS inside FROM r WHERE k = 1
""")
def signed_offsets(spark, sf_dir):
    front = lines(spark, sf_dir).where("k = 8").select("i", F.col("y").alias("x"), F.col("x").alias("y"))
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), (F.col("s_suppkey") * 53 % 1000).cast("double").alias("y"))
    return P.signed_offsets(p, front, pid="id", order="i").select("id", F.round("offset", 4).alias("offset"), "inside")


@query(f"""
WITH {LINES}, r AS (SELECT x AS a0, y AS v0, lead(x) OVER (ORDER BY x) AS a1, lead(y) OVER (ORDER BY x) AS v1 FROM line WHERE k = 8), p AS (SELECT c_custkey AS id, (c_custkey % 900)::DOUBLE - 20 AS x, c_acctbal / 100 AS v FROM customer), e AS (SELECT min(a0) AS l, max(a0) AS h, min_by(v0, a0) AS lv, max_by(v0, a0) AS hv FROM r)
SELECT id, round(v - CASE WHEN x <= l THEN lv WHEN x >= h THEN hv ELSE v0 + (v1 - v0) * (x - a0) / (a1 - a0) END, 4) AS "offset" FROM p CROSS JOIN e LEFT JOIN r ON a1 IS NOT NULL AND x >= a0 AND x < a1
""")
def row_offsets(spark, sf_dir):
    ref = lines(spark, sf_dir).where("k = 8").select("x", "y")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") % 900).cast("double") - 20).alias("x"), (F.col("c_acctbal") / 100).alias("v"))
    return P.interpolated(ref, rows, at="x", value="y").select("id", F.round(F.col("v") - F.col("reference"), 4).alias("offset"))


@query("""
WITH c AS (SELECT p_partkey AS id, least(p_size % 10, p_partkey % 7) AS p, greatest(p_size % 10, p_partkey % 7) AS q, p_retailprice AS n, p_brand AS m FROM part)
SELECT id, coalesce((SELECT min(o.id) FROM c o WHERE o.p = c.p AND o.q = c.q AND o.m = c.m AND o.id < c.id AND abs(o.n - c.n) < 0.1 * c.n), id) AS canon FROM c
""")
def canonical_chains(spark, sf_dir):
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 10).alias("a"), (F.col("p_partkey") % 7).alias("b"), F.col("p_retailprice").alias("n"), F.col("p_brand").alias("m"))
    return P.canonical(c, chain="id", a="a", b="b", length="n", same="m")


@query(f"""
WITH {ROUTES}, ch AS (SELECT s_suppkey AS section, s_acctbal AS up, s_acctbal / 2 AS down, s_acctbal - 4000 AS steep, s_suppkey % 3 AS kind, s_nationkey * 10.0::DOUBLE AS size FROM supplier WHERE s_suppkey < 40),
m AS (SELECT route, seq, up, down, steep, kind, size, seq % 2 = 0 AS fore FROM legs JOIN ch USING (section)), k AS (SELECT route, 'h' || kind AS name, sum(size) AS size FROM m GROUP BY 1, 2), s AS (SELECT route, string_agg(name || '=' || CAST(CAST(size AS BIGINT) AS VARCHAR), ' ' ORDER BY name) AS sums FROM k GROUP BY route)
SELECT route, round(sum(CASE WHEN fore THEN up ELSE down END), 4) AS up, round(sum(CASE WHEN fore THEN down ELSE up END), 4) AS down, max(abs(steep)) AS steepest, any_value(sums) AS sums FROM m JOIN s USING (route) GROUP BY route
""")
def route_rollup(spark, sf_dir):
    sup = table(spark, sf_dir, "supplier").where("s_suppkey < 40")
    name = F.concat(F.lit("h"), (F.col("s_suppkey") % 3).cast("string"))
    chains = sup.select(F.col("s_suppkey").alias("section"), F.col("s_acctbal").alias("up"), (F.col("s_acctbal") / 2).alias("down"), (F.col("s_acctbal") - 4000).alias("steep"), F.create_map(name, F.col("s_nationkey") * 10.0).alias("lengths"))
    steps = legs(spark, sf_dir).withColumn("way", F.when(F.col("seq") % 2 == 0, 1).otherwise(-1))
    got = P.rollup(steps, chains, route="route", chain="section", direction="way")
    sums = F.array_join(F.transform(F.map_entries("sums"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("long").cast("string"))), " ")
    return got.select("route", F.round("up", 4).alias("up"), F.round("down", 4).alias("down"), "steepest", sums.alias("sums"))


@query("""
SELECT o_custkey AS tour, o_orderkey AS leg, round(coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS "offset" FROM orders
""")
def chained_legs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tour"), F.col("o_orderkey").alias("leg"), F.struct("o_orderdate", "o_orderkey").alias("ord"), "o_totalprice")
    return P.chained_legs(o, tour="tour", order="ord", length="o_totalprice").select("tour", "leg", F.round("offset", 2).alias("offset"))


@query(f"""
WITH {LINES}, a AS (SELECT k, x AS a, lead(x, 5) OVER w AS b, abs(lead(y, 5) OVER w - y) / 50 AS grade FROM line WINDOW w AS (PARTITION BY k ORDER BY x)), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY grade DESC, a, b DESC) AS n FROM a WHERE b IS NOT NULL), e AS (SELECT k, min(x) AS lo, max(x) AS hi FROM line GROUP BY k)
SELECT k, round(grade, 6) AS grade, a AS "from", a - lo < 100 OR hi - b < 100 AS at_end FROM r JOIN e USING (k) WHERE n = 1
""")
def steepest_at_end(spark, sf_dir):
    return P.steepest_at_end(lines(spark, sf_dir), key="k", at="x", value="y", steps=5, near=100.0).withColumn("grade", F.round("grade", 6))


@query("SELECT l_partkey AS way, max(l_extendedprice) AS pop, count(*) AS links FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY pop DESC, way LIMIT 15")
def largest_cuts(spark, sf_dir):
    cut = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("way"), F.col("l_extendedprice").alias("pop"))
    return P.largest_of_way(cut, way="way", weight="pop", limit=15)


@query("""
WITH t AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type AS c FROM events), n AS (SELECT *, i - row_number() OVER (PARTITION BY k, c ORDER BY i) AS g FROM t),
r AS (SELECT k, c, min(i)::DOUBLE AS a, max(i)::DOUBLE + 1 AS b FROM n GROUP BY k, c, g), s AS (SELECT DISTINCT k, floor(i / 20) * 20 AS lo, floor(i / 20) * 20 + 7 AS hi FROM t)
SELECT CASE WHEN c = 'error' AND EXISTS (SELECT 1 FROM s WHERE s.k = r.k AND (a + b) / 2 >= lo AND (a + b) / 2 < hi) THEN 'known' ELSE c END AS c, count(*) AS n FROM r GROUP BY 1
""")
def relabelled_runs(spark, sf_dir):
    w = O.over("user_id", ["ts", "event_id"])
    t = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.row_number().over(w).alias("i"), F.col("event_type").alias("c"))
    g = t.withColumn("g", F.col("i") - F.row_number().over(Window.partitionBy("k", "c").orderBy("i")))
    runs = g.groupBy("k", "c", "g").agg(F.min("i").cast("double").alias("a"), (F.max("i").cast("double") + 1).alias("b")).select("k", "a", "b", "c")
    lo = F.floor(F.col("i") / 20) * 20
    stretches = t.select("k", lo.alias("lo"), (lo + 7).alias("hi")).distinct()
    return P.relabelled(runs, stretches, key="k", label="c", old="error", new="known").groupBy("c").agg(F.count("*").alias("n"))


@query("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1), r AS (SELECT v, strftime(day, '%Y-%m-%d') AS o, dayofmonth(day) % 3 = 0 AS c FROM d), k AS (SELECT count(*) FILTER (c) AS k, avg(v) FILTER (c) AS observed FROM r),
e AS (SELECT draw, v, row_number() OVER (PARTITION BY draw ORDER BY CAST('0x' || substr(md5('6674:' || draw || ':' || o), 1, 12) AS BIGINT), o) AS r FROM r, generate_series(0, 1999) g(draw)), m AS (SELECT draw, avg(v) AS m FROM e, k WHERE r <= k GROUP BY draw)
SELECT round(any_value(observed), 8) AS observed, round((count(*) FILTER (m >= observed - 1e-12) + 1) / 2001, 8) AS p FROM m, k
""")
def permutation_test(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    got = P.permutation_p(days.withColumn("o", F.date_format("day", "yyyy-MM-dd")), value="v", chosen=F.dayofmonth("day") % 3 == 0, order="o", draws=2000, seed=6674)
    return got.select(F.round("observed", 8).alias("observed"), F.round("p", 8).alias("p"))


@query("""
SELECT event_id, CASE WHEN regexp_matches(event_type, '[A-Za-z]{3,}') THEN 'latin' ELSE 'other' END AS script, strftime(ts, '%Y%m%d') AS day, strftime(ts, '%H:%M') AS time, round(year(ts) + (dayofyear(ts) - 1) / 365.25, 6) AS yearly, 11.0::DOUBLE + 5.0::DOUBLE * (event_id % 7) AS radius,
 CASE WHEN event_id % 2 = 0 THEN '#ffffff' ELSE '#8888ff' END AS light, regexp_replace(regexp_replace(regexp_replace(printf('%.2f', value / 7), '(\\.\\d*?)0+$', '\\1'), '\\.$', ''), '^0\\.', '.') AS shown FROM events
""")
def scalar_functions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    taken = G.time_in_name(F.concat(F.lit("img/"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".jpg")))
    colour = F.when(F.col("event_id") % 2 == 0, "#ffffff").otherwise("#1111ff")
    return e.select(
        "event_id",
        F.when(T.has_cjk(F.col("event_type")), "cjk").when(T.has_latin(F.col("event_type")), "latin").otherwise("other").alias("script"),
        taken["day"].alias("day"),
        taken["time"].alias("time"),
        F.round(T.fractional_year(F.col("ts")), 6).alias("yearly"),
        T.radius_of(F.col("event_id") % 7).alias("radius"),
        T.lightened(colour, 0.5).alias("light"),
        T.trimmed_number(F.col("value") / 7, 2).alias("shown"),
    )


@query("""
WITH a AS (SELECT o_custkey AS k, max(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS a, max(o_totalprice) FILTER (o_orderpriority = '2-HIGH') AS b, max(o_totalprice) FILTER (o_orderpriority = '3-MEDIUM') AS c, max(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS d FROM orders GROUP BY 1),
m AS (SELECT *, list_aggregate(list_filter([a, b, c, d], lambda x: x IS NOT NULL), 'median') AS m FROM a), f AS (SELECT k, m, list_filter([a, b, c, d], lambda x: x IS NOT NULL AND abs(x - m) <= 60000) AS near FROM m)
SELECT k, round(m, 4) AS consensus, list_min(near) AS low, list_max(near) AS high, len(near) AS n, CASE WHEN len(near) = 4 THEN 'both' WHEN len(near) = 3 THEN 'foot' WHEN len(near) = 2 THEN 'grid' ELSE 'far' END AS follow FROM f
""")
def envelope(spark, sf_dir):
    """Several measurements of one thing: their median, and the range of those near it."""
    kinds = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(*[F.max(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice"))).alias(f"v{i}") for i, p in enumerate(kinds)])
    known = F.array_compact(F.array(*[f"v{i}" for i in range(4)]))
    s, n = F.sort_array(known), F.size(known)
    m = F.when(n > 0, (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2)
    g = g.withColumn("m", m).withColumn("near", F.filter(known, lambda x: F.abs(x - F.col("m")) <= 60_000))
    size = F.size("near")
    follow = first_rule([(size == 4, "both"), (size == 3, "foot"), (size == 2, "grid")], "far")
    return g.select("k", F.round("m", 4).alias("consensus"), F.array_min("near").alias("low"), F.array_max("near").alias("high"), size.cast("long").alias("n"), follow.alias("follow"))
