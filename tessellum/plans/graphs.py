"""Queries of graphs, on a network of nations linked by trade."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessellum.operators import graph as G
from tessellum.operators.components import components as _components

from .registry import query, table

#: Supplier nation to customer nation over all lines; weights by the keys and the number of lines. 625 edges at most.
NET = """net AS (SELECT s_nationkey AS u, c_nationkey AS v, 10 + (s_nationkey * 31 + c_nationkey * 17) % 97 * 10 + count(*) % 10 AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2)"""
#: Nations in a row within their region, the first of each tied to the region, and the regions in a row.
ROWS = """tied AS (SELECT n_nationkey AS u, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS v FROM nation UNION ALL SELECT min(n_nationkey), 100 + n_regionkey FROM nation GROUP BY n_regionkey
 UNION ALL SELECT 100 + r_regionkey, 101 + r_regionkey FROM region WHERE r_regionkey < (SELECT max(r_regionkey) FROM region)), rows AS (SELECT u, v, u + v AS w FROM tied WHERE v IS NOT NULL)"""


def net(spark, sf_dir):
    o, c, s = (table(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    df = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    w = (10 + (F.col("s_nationkey") * 31 + F.col("c_nationkey") * 17) % 97 * 10 + F.count("*") % 10).alias("w")
    counted = df.where("s_nationkey <> c_nationkey").groupBy("s_nationkey", "c_nationkey").agg(w)
    return counted.select(F.col("s_nationkey").cast("long").alias("u"), F.col("c_nationkey").cast("long").alias("v"), "w")


def in_rows(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key, region = F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long")
    after = n.select(key.alias("u"), F.lead(key).over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("v"))
    tied = n.groupBy("n_regionkey").agg(F.min(key).alias("u")).select("u", (region + 100).alias("v"))
    last = r.agg(F.max("r_regionkey").alias("m"))
    chain = r.crossJoin(F.broadcast(last)).where("r_regionkey < m").select((F.col("r_regionkey").cast("long") + 100).alias("u"), (F.col("r_regionkey").cast("long") + 101).alias("v"))
    return after.where("v IS NOT NULL").unionByName(tied).unionByName(chain).withColumn("w", F.col("u") + F.col("v"))


@query(f"""
WITH RECURSIVE {NET}, p AS (SELECT n AS node, n AS source, 0 AS d FROM (VALUES (0), (1)) t(n)
 UNION SELECT net.v, p.source, p.d + w FROM p JOIN net ON net.u = p.node WHERE p.d + w < 600),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY d, source) AS k FROM p)
SELECT CAST(node AS BIGINT) AS node, CAST(source AS BIGINT) AS source, CAST(d AS DOUBLE) AS dist FROM r WHERE k = 1
""")
def shortest_paths(spark, sf_dir):
    start = spark.createDataFrame([(0, 0, 0.0), (1, 1, 0.0)], "node long, source long, dist double")
    return G.shortest_paths(net(spark, sf_dir), start, cutoff=599.5)


@query(f"""
WITH RECURSIVE {NET}, open AS (SELECT * FROM net WHERE (u + v) % 3 <> 0), p AS (SELECT 0 AS node, 0 AS d UNION SELECT open.v, p.d + w FROM p JOIN open ON open.u = p.node WHERE p.d + w < 700)
SELECT CAST(node AS BIGINT) AS node, CAST(min(d) AS DOUBLE) AS dist FROM p GROUP BY node
""")
def paths_with_closures(spark, sf_dir):
    n = net(spark, sf_dir)
    start = spark.createDataFrame([(0, 0, 0.0)], "node long, source long, dist double")
    return G.shortest_paths(n, start, closed=n.where("(u + v) % 3 = 0"), cutoff=699.5).select("node", "dist")


def bought(spark, sf_dir):
    """Customers and the parts that they bought, all of them; parts are numbered below zero."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(F.col("o_custkey").alias("u"), (-1 - F.col("l_partkey")).alias("v")).distinct()


@query()
def components(spark, sf_dir):
    return _components(bought(spark, sf_dir))


@query()
def largest_component(spark, sf_dir):
    return G.largest_component(bought(spark, sf_dir))


@query(f"""
WITH RECURSIVE {ROWS}, both_ways AS (SELECT u AS x, v AS y FROM rows WHERE u < 100 AND v < 100 UNION SELECT v, u FROM rows WHERE u < 100 AND v < 100), r AS (SELECT DISTINCT x AS node, x AS c FROM both_ways UNION SELECT y, c FROM r JOIN both_ways ON x = node)
SELECT CAST(node AS BIGINT) AS node, CAST(min(c) AS BIGINT) AS component FROM r GROUP BY node
""")
def nation_components(spark, sf_dir):
    """Nations linked within their regions."""
    return _components(in_rows(spark, sf_dir).where("u < 100 AND v < 100"))


@query(f"WITH {NET} SELECT CAST(node AS BIGINT) AS node, count(*) AS degree FROM (SELECT u AS node FROM net UNION ALL SELECT v FROM net) GROUP BY 1")
def degrees(spark, sf_dir):
    return G.degrees(net(spark, sf_dir))


@query("""
WITH RECURSIVE t AS (SELECT c_custkey AS node, c_custkey // 3 AS up FROM customer WHERE c_custkey > 0), r AS (SELECT 7 AS node, 0 AS step UNION ALL SELECT t.node, r.step + 1 FROM r JOIN t ON t.up = r.node)
SELECT CAST(7 AS BIGINT) AS start, CAST(node AS BIGINT) AS node, CAST(step AS INTEGER) AS step FROM r
""")
def upstream_trace(spark, sf_dir):
    links = table(spark, sf_dir, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("node"), F.floor(F.col("c_custkey") / 3).alias("up"))
    return G.trace(links, spark.createDataFrame([(7,)], "node long"), src="up", dst="node")


@query(f"""
WITH RECURSIVE {NET}, p AS (SELECT [0] AS path, 0 AS d UNION ALL SELECT list_append(path, net.v), d + w FROM p JOIN net ON net.u = path[-1] AND NOT list_contains(path, net.v) WHERE len(path) <= 4 AND path[-1] <> 4),
best AS (SELECT min(d) AS m FROM p WHERE path[-1] = 4)
SELECT array_to_string(path, '-') AS path, CAST(d AS DOUBLE) AS length FROM p, best WHERE path[-1] = 4 AND d <= m * 1.3
""")
def alternative_paths(spark, sf_dir):
    got = G.simple_paths(net(spark, sf_dir), start=0, end=4, stretch=1.3)
    return got.select(F.array_join("path", "-").alias("path"), "length")


@query(f"""
WITH {ROWS}, d AS (SELECT n, count(*) AS k FROM (SELECT u AS n FROM rows UNION ALL SELECT v FROM rows) GROUP BY n)
SELECT count(*) AS edges, CAST(sum(w) AS BIGINT) AS total, (SELECT count(*) FROM d WHERE k <> 2) AS ends FROM rows
""")
def corridor_totals(spark, sf_dir):
    """Totals that contraction must keep: edges, weights and the nodes that aren't of degree 2."""
    e = in_rows(spark, sf_dir)
    ends = G.degrees(e).where("degree <> 2").agg(F.count("*").alias("ends"))
    return G.contracted(e).agg(F.sum("n").alias("edges"), F.sum("total").alias("total")).crossJoin(F.broadcast(ends))


@query()
def corridors(spark, sf_dir):
    return G.contracted(in_rows(spark, sf_dir))


@query()
def bridges(spark, sf_dir):
    weights = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("node")).agg(F.count("*").alias("weight"))
    return G.bridges(in_rows(spark, sf_dir), weights, root=100)


@query()
def plateau_edges(spark, sf_dir):
    return G.plateaus(net(spark, sf_dir), start=0, end=4)


@query(f"WITH {NET} SELECT CAST(coalesce(sum(a.w), 0) AS DOUBLE) AS length FROM (SELECT * FROM net WHERE u < 12) a WHERE EXISTS (SELECT 1 FROM net b WHERE b.v < 12 AND least(a.u, a.v) = least(b.u, b.v) AND greatest(a.u, a.v) = greatest(b.u, b.v))")
def shared_route_length(spark, sf_dir):
    n = net(spark, sf_dir).withColumn("w", F.col("w").cast("double"))
    return G.shared_length(n.where("u < 12"), n.where("v < 12"))
