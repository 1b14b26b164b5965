"""Queries of rule-based joins and of rasters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessellum.functions import rules
from tessellum.functions import text as T
from tessellum.functions.geo import axial_difference
from tessellum.operators import joins as J
from tessellum.operators import ordered as O
from tessellum.operators import rasters as R
from tessellum.operators import spatial as S
from tessellum.operators.drainage import drainage as drained

from .registry import query, table
from .spatial import CELLS, PTS, SUP, cells, places, points


@query("""
WITH k AS (SELECT n_nationkey, lower(replace(n_name, ' ', '')) AS k FROM nation), a AS (SELECT n_nationkey, CASE k WHEN 'nation_1' THEN 'region_x' ELSE k END AS k FROM k)
SELECT a.n_nationkey, s.s_suppkey FROM a LEFT JOIN (SELECT s_suppkey, lower(replace(replace(n.n_name, ' ', ''), '#', '')) AS k FROM supplier JOIN nation n ON n_nationkey = s_nationkey) s ON s.k = a.k
""")
def alias_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    sup = table(spark, sf_dir, "supplier").join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("name")), "s_nationkey")
    got = J.matched_by_name(n, sup.select("s_suppkey", "name"), left_key=T.normal_key(F.col("n_name")), right_key=T.normal_key(F.regexp_replace("name", "#", "")), aliases={"nation_1": "region_x"})
    return got.select("n_nationkey", "s_suppkey")


@query("""
SELECT k, 'left' AS side FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 40) WHERE k NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)
UNION ALL SELECT p_partkey, 'right' FROM part WHERE p_size < 40 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)
""")
def unmatched_keys(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("k"))
    return J.unmatched(a, table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("k")), "k")


@query("""
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2), o AS (SELECT o_orderkey AS k FROM orders)
SELECT o.k, coalesce(a.v, b.v, c.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'fine' WHEN b.v IS NOT NULL THEN 'mid' WHEN c.v IS NOT NULL THEN 'coarse' ELSE '' END AS source
FROM o LEFT JOIN l a ON a.k = o.k AND a.n = 6 LEFT JOIN l b ON b.k = o.k AND b.n = 4 LEFT JOIN l c ON c.k = o.k AND c.n = 1
""")
def fallback_sources(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    one = lambda n: lines.where(f"l_linenumber = {n}").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_quantity").alias("v"))
    return J.first_known(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), [("fine", one(6)), ("mid", one(4)), ("coarse", one(1))], key="k", value="v")


@query("SELECT k, max_by(v, i) AS v FROM (SELECT c_custkey AS k, c_acctbal AS v, 0 AS i FROM customer UNION ALL SELECT s_suppkey * 7, s_acctbal, 1 FROM supplier) GROUP BY k")
def layered_override(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return J.last_file_wins([a, table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 7).alias("k"), F.col("s_acctbal").alias("v"))], key="k")


@query("""
WITH d AS (SELECT c_custkey AS k, n_nationkey AS name, abs(c_acctbal - 400 * n_nationkey) * CASE WHEN n_regionkey = 0 THEN 1.6::DOUBLE ELSE 1.0::DOUBLE END AS d FROM customer, nation)
SELECT k, CAST(min_by(name, d * 1000 + name * 1e-6) AS INTEGER) AS name FROM d GROUP BY k
""")
def weighted_nearest_label(spark, sf_dir):
    labels = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("name"), "n_regionkey")
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    return J.nearest_label(p, labels, key="k", name="name", distance=F.abs(F.col("c_acctbal") - 400 * F.col("name")), weight=F.when(F.col("n_regionkey") == 0, 1.6).otherwise(1.0))


@query(f"""
WITH {PTS}, {SUP}, m AS (SELECT id, sid, sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) AS d, ((id * 13) % 180 - (sid * 29) % 180 + 180) % 180 AS g FROM pts p JOIN sup s ON sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) <= 250),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, sid) AS k FROM m WHERE least(g, 180 - g) <= 30) SELECT id, sid FROM k WHERE k = 1
""")
def angular_match(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("course", (F.col("id") * 13 % 180).cast("double"))
    s = places(spark, sf_dir).withColumn("other", (F.col("sid") * 29 % 180).cast("double"))
    turned = axial_difference(F.col("course"), F.col("other"))
    return S.nearest(p, s, lid="id", rid="sid", size=250.0, reach=250.0, own=("course",), other=("other",), where=turned <= 30).select("id", "sid")


@query("""
WITH m AS (SELECT l_orderkey AS k, l_suppkey % 5 AS code, sum(l_quantity) AS n FROM lineitem WHERE l_discount > 0.03 GROUP BY 1, 2), w AS (SELECT l_orderkey AS k, sum(l_quantity) AS w FROM lineitem GROUP BY 1),
r AS (SELECT m.*, row_number() OVER (PARTITION BY k ORDER BY n DESC, code DESC) AS i, sum(n) OVER (PARTITION BY k) AS s FROM m)
SELECT k, code FROM r JOIN w USING (k) WHERE i = 1 AND s / w >= 0.5
""")
def length_votes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 5).alias("code"), "l_quantity", "l_discount")
    whole = lines.groupBy("k").agg(F.sum("l_quantity").alias("w"))
    return J.votes(lines.where("l_discount > 0.03").join(whole, "k"), by="k", code="code", length=F.col("l_quantity"), whole=F.col("w"), least_share=0.5)


@query("""
WITH i AS (SELECT l_orderkey AS k, l_orderkey * 10 + l_linenumber AS id, l_linenumber AS n, l_quantity AS lo, l_quantity + 4 AS hi FROM lineitem)
SELECT a.k, count(*) AS pairs, sum(least(a.hi, b.hi) - greatest(a.lo, b.lo)) AS shared FROM i a JOIN i b ON a.k = b.k AND a.n <= 3 AND b.n > 3 AND least(a.hi, b.hi) - greatest(a.lo, b.lo) > 0.5 GROUP BY a.k
""")
def shared_edges(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    df = df.select(F.col("l_orderkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("lo"), (F.col("l_quantity") + 4).alias("hi"))
    hit = J.interval_hits(df.where("n <= 3"), df.where("n > 3"), key="k", least=0.5)
    return hit.groupBy("k").agg(F.count("*").alias("pairs"), F.sum("shared").alias("shared"))


@query("""
WITH s AS (SELECT o_custkey AS route, o_orderkey AS node, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders)
SELECT route, count(*) AS legs, CAST(sum(abs(b - node)) AS BIGINT) AS far FROM s WHERE b IS NOT NULL GROUP BY route
""")
def route_legs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("route"), F.struct("o_orderdate", "o_orderkey").alias("ord"), F.col("o_orderkey").alias("node"))
    legs = J.lagged_pairs(o, route="route", order="ord", node="node")
    return legs.groupBy("route").agg(F.count("*").alias("legs"), F.sum(F.abs(F.col("b") - F.col("a"))).alias("far"))


@query(f"WITH {CELLS}, o AS (SELECT r, c + 1 AS c, v - 5 AS v FROM cells) SELECT r, c, max(v) AS v FROM (SELECT * FROM cells UNION ALL SELECT * FROM o) GROUP BY r, c")
def merged_sheets(spark, sf_dir):
    a = cells(spark, sf_dir)
    return R.merge_max(a, a.select("r", (F.col("c") + 1).alias("c"), (F.col("v") - 5).alias("v")))


@query(f"""WITH {CELLS}, k AS (SELECT r, c, v > 25 AS m FROM cells), g AS (SELECT r, m, c, c - row_number() OVER (PARTITION BY r, m ORDER BY c) AS g FROM k)
SELECT r, m, min(c) AS c0, max(c) + 1 AS c1 FROM g GROUP BY r, m, g""")
def raster_runs(spark, sf_dir):
    return R.row_runs(cells(spark, sf_dir).withColumn("m", F.col("v") > 25), value="m")


@query(f"WITH {CELLS}, a AS (SELECT CAST(floor(v / 10) AS BIGINT) AS k, sum(100.0::DOUBLE - r) AS area FROM cells GROUP BY 1) SELECT k, area, round(100 * area / (SELECT sum(area) FROM a), 6) AS percent FROM a")
def land_shares(spark, sf_dir):
    a = cells(spark, sf_dir).withColumn("k", F.floor(F.col("v") / 10))
    area = a.select("r").distinct().withColumn("area", F.lit(100.0) - F.col("r"))
    return R.class_shares(a, area, value="k").select("k", "area", F.round("percent", 6).alias("percent"))


@query(f"""WITH {CELLS}, l AS (SELECT s_suppkey AS k, (s_suppkey % 40)::DOUBLE AS x0, (s_suppkey * 7 % 40)::DOUBLE AS y0, (s_suppkey * 3 % 40)::DOUBLE AS x1, (s_suppkey * 11 % 40)::DOUBLE AS y1 FROM supplier),
n AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS size, greatest(ceil(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) / 0.7), 1) AS n FROM l), s AS (SELECT k, x0 + (x1 - x0) * i / n AS x, y0 + (y1 - y0) * i / n AS y, size / (n + 1) AS d FROM n, unnest(generate_series(0, CAST(n AS BIGINT))) u(i))
SELECT k, bool_or(v IS NOT NULL) AS inside, round(sum(CASE WHEN v IS NOT NULL THEN d ELSE 0 END), 6) AS length FROM s LEFT JOIN (SELECT * FROM cells WHERE v > 30) m ON m.r = floor(y) AND m.c = floor(x) GROUP BY k""")
def lines_in_mask(spark, sf_dir):
    k = F.col("s_suppkey")
    lines = table(spark, sf_dir, "supplier").select(k.alias("k"), *[(k * m % 40).cast("double").alias(n) for n, m in (("x0", 1), ("y0", 7), ("x1", 3), ("y1", 11))])
    return R.lines_in_mask(lines, cells(spark, sf_dir).where("v > 30"), key="k", step=0.7).select("k", "inside", F.round("length", 6).alias("length"))


@query(f"""WITH {CELLS}, a AS (SELECT r, c FROM cells WHERE v > 40), b AS (SELECT r + 2 AS r, c - 1 AS c FROM cells WHERE v > 38), s AS (SELECT * FROM generate_series(-4, 4) x(dr), generate_series(-4, 4) y(dc)),
k AS (SELECT dr, dc, count(*) AS k FROM b, s JOIN a ON a.r = b.r + dr AND a.c = b.c + dc GROUP BY 1, 2)
SELECT CAST(dr AS INTEGER) AS dr, CAST(dc AS INTEGER) AS dc, round(k / ((SELECT count(*) FROM a) + (SELECT count(*) FROM b) - k), 8) AS iou FROM k ORDER BY iou DESC, abs(dr) + abs(dc), dr, dc LIMIT 1""")
def best_shift(spark, sf_dir):
    a = cells(spark, sf_dir)
    b = a.where("v > 38").select((F.col("r") + 2).alias("r"), (F.col("c") - 1).alias("c"))
    return R.best_shift(a.where("v > 40"), b).select("dr", "dc", F.round("iou", 8).alias("iou"))


@query()
def drainage(spark, sf_dir):
    return drained(cells(spark, sf_dir).withColumn("grid", F.concat(F.lit("g"), F.floor(F.col("r") / 20).cast("string"))), size=16)


@query()
def smoothest_states(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seq = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("route"), F.row_number().over(w).cast("long").alias("seq"), "value")
    states = seq.withColumn("state", F.explode(F.array(*[F.lit(float(s)) for s in (0, 10, 20, 40)])))
    return R.best_states(states.select("route", "seq", "state", F.abs(F.col("value") - F.col("state")).alias("cost")), turn=0.5)


@query("""
WITH t AS (SELECT user_id, ts, event_id, CASE WHEN value > 40 THEN 'steep' WHEN event_type = 'error' THEN 'blocked' WHEN value > 10 THEN 'slope' ELSE 'flat' END AS cls FROM events),
e AS (SELECT *, CASE WHEN cls = lag(cls) OVER w THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT cls, count(*) AS runs, CAST(max(n) AS BIGINT) AS longest FROM (SELECT user_id, run, min(cls) AS cls, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY cls
""")
def priority_runs(spark, sf_dir):
    v = F.col("value")
    cls = rules.first_rule([(v > 40, "steep"), (F.col("event_type") == "error", "blocked"), (v > 10, "slope")], "flat")
    runs = O.islands(table(spark, sf_dir, "events").withColumn("cls", cls), key="user_id", order=["ts", "event_id"], same="cls")
    return runs.groupBy(F.col("value").alias("cls")).agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


@query("""
SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY abs(d) DESC, event_id) AS k FROM (
 SELECT user_id, event_id, value - lag(value, 10) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) WHERE d IS NOT NULL) WHERE k = 1
""")
def steepest_window(spark, sf_dir):
    w = O.over("user_id", ["ts", "event_id"])
    d = table(spark, sf_dir, "events").withColumn("d", F.abs(F.col("value") - F.lag("value", 10).over(w))).where("d IS NOT NULL")
    return d.groupBy("user_id").agg(F.max(F.struct("d", (-F.col("event_id")).alias("e"))).alias("m")).select((-F.col("m.e")).alias("event_id"))


@query("""
SELECT l_orderkey, max(l_extendedprice) AS most, CAST(max_by(l_linenumber, l_extendedprice * 100 - l_linenumber) AS INTEGER) AS at FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 5
""")
def arg_extremes(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
    return g.agg(F.max("l_extendedprice").alias("most"), F.max_by("l_linenumber", F.col("l_extendedprice") * 100 - F.col("l_linenumber")).alias("at"), F.count("*").alias("n")).where("n >= 5").drop("n")


@query("""
WITH a AS (SELECT l_returnflag AS g, sum(l_quantity) FILTER (l_discount < 0.05) AS young, sum(l_quantity) FILTER (l_discount >= 0.05) AS old FROM lineitem GROUP BY 1)
SELECT g, round(young * 0.8 + old * 0.93, 4) AS projected, round(100 * (old * 0.93) / (young * 0.8 + old * 0.93), 4) AS old_share FROM a
""")
def weighted_projection(spark, sf_dir):
    q, low = F.col("l_quantity"), F.col("l_discount") < 0.05
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(F.sum(F.when(low, q)).alias("young"), F.sum(F.when(~low, q)).alias("old"))
    total = F.col("young") * 0.8 + F.col("old") * 0.93
    return a.select("g", F.round(total, 4).alias("projected"), F.round(100 * (F.col("old") * 0.93) / total, 4).alias("old_share"))


@query("""
SELECT c_custkey, c_acctbal FROM customer ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, c_acctbal DESC NULLS LAST, c_custkey LIMIT 8
""")
def ranked_hits(spark, sf_dir):
    kind = F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1)
    return table(spark, sf_dir, "customer").orderBy(kind, F.desc_nulls_last("c_acctbal"), "c_custkey").limit(8).select("c_custkey", "c_acctbal")


#: Customers as ways along rows, with small gaps between them, some missing and every third drawn from its end.
WAYS = """ways AS (SELECT k AS way, CASE WHEN k % 3 = 1 THEN b ELSE a END AS x0, y AS y0, CASE WHEN k % 3 = 1 THEN a ELSE b END AS x1, y AS y1 FROM (SELECT c_custkey AS k, (c_custkey % 40) * 10.0::DOUBLE + (c_custkey * 7 % 5) * 0.05::DOUBLE AS a,
 (c_custkey % 40) * 10.0::DOUBLE + (c_custkey * 7 % 5) * 0.05::DOUBLE + 9.6 AS b, (c_custkey // 40) * 50.0::DOUBLE + (c_custkey % 3) * 0.01::DOUBLE AS y FROM customer WHERE c_custkey % 7 <> 3))"""


@query(f"""
WITH RECURSIVE {WAYS}, ends AS (SELECT way, 0 AS k, x0 AS x, y0 AS y FROM ways UNION ALL SELECT way, 1, x1, y1 FROM ways),
near AS (SELECT p.way, p.k, q.way AS way2, q.k AS k2, row_number() OVER (PARTITION BY p.way, p.k ORDER BY sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), q.way * 2 + q.k) AS i FROM ends p JOIN ends q ON p.way <> q.way AND abs(p.y - q.y) <= 1 WHERE sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) <= 1),
met AS (SELECT a.way, a.k, a.way2, a.k2 FROM near a JOIN near b ON b.way = a.way2 AND b.k = a.k2 AND b.way2 = a.way AND b.k2 = a.k WHERE a.i = 1 AND b.i = 1),
c AS (SELECT way, way AS chain, false AS turned FROM ways UNION SELECT m.way2, c.chain, c.turned <> (m.k = m.k2) FROM c JOIN met m ON m.way = c.way), n AS (SELECT *, row_number() OVER (PARTITION BY way ORDER BY chain) AS i FROM c)
SELECT chain, way, turned FROM n WHERE i = 1
""")
def joined_ways(spark, sf_dir):
    """Ways put end to end over gaps of at most one, each turned like the one of least number."""
    k = F.col("c_custkey")
    own = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 3").select(k.alias("way"), (k % 40 * 10.0 + k * 7 % 5 * 0.05).alias("a"), (F.floor(k / 40) * 50.0 + k % 3 * 0.01).alias("y"))
    turned = F.col("way") % 3 == 1
    ends = own.withColumn("b", F.col("a") + 9.6).select("way", F.when(turned, F.col("b")).otherwise(F.col("a")).alias("x0"), F.col("y").alias("y0"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("x1"), F.col("y").alias("y1"))
    return J.joined_ways(ends, gap=1.0).select("chain", "way", "turned")
