"""Queries of rule tables: which network a way belongs to, how safe a refuge is, what kind a lot has."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellum.functions import rules

from .registry import query, table

#: Parts as ways: tags of the road network drawn from a part's columns.
HIGHWAYS = ["motorway", "primary", "residential", "service", "construction", "footway", "trunk_link", "living_street"]
TAGS = f"""w AS (SELECT p_partkey AS way, {HIGHWAYS}[p_partkey % 8 + 1] AS highway, CASE p_size % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'private' WHEN 2 THEN 'yes' END AS access, CASE p_size % 7 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN 'designated' END AS foot,
 CASE p_size % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS area, CASE p_size % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'permissive' END AS mv, CASE p_size % 11 WHEN 3 THEN 'no' END AS mc, CASE p_partkey % 3 WHEN 0 THEN 'parking_aisle' WHEN 1 THEN 'driveway' END AS service, CASE WHEN p_size > 5 THEN p_size < 12 END AS narrow FROM part)"""


def tags(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        k.alias("way"),
        F.element_at(F.array(*map(F.lit, HIGHWAYS)), (k % 8 + 1).cast("int")).alias("highway"),
        F.when(s % 5 == 0, "no").when(s % 5 == 1, "private").when(s % 5 == 2, "yes").alias("access"),
        F.when(s % 7 == 0, "no").when(s % 7 == 1, "yes").when(s % 7 == 2, "designated").alias("foot"),
        F.when(s % 6 == 0, "yes").when(s % 6 == 1, "no").alias("area"),
        F.when(s % 4 == 0, "no").when(s % 4 == 1, "permissive").alias("mv"),
        F.when(s % 11 == 3, "no").alias("mc"),
        F.when(k % 3 == 0, "parking_aisle").when(k % 3 == 1, "driveway").alias("service"),
        F.when(s > 5, s < 12).alias("narrow"),
    )


IN = lambda col, *v: f"coalesce({col} IN ({', '.join(map(repr, v))}), false)"
SHUT = f"({IN('access', 'no', 'private')} AND NOT {IN('{own}', 'yes', 'designated', 'permissive')})"


@query(f"""
WITH {TAGS} SELECT way, NOT {SHUT.format(own="foot")} AND NOT {IN("highway", *rules.WALK_NO)} AND NOT {IN("foot", "no")} AND NOT {IN("area", "yes")} AS walk,
 NOT {SHUT.format(own="mv")} AND {IN("highway", *rules.CAR_OK)} AND NOT ({IN("mv", "no")} OR {IN("mc", "no")} OR (highway = 'service' AND {IN("service", "parking_aisle", "drive-through")}) OR coalesce(narrow, false)) AS car,
 {IN("highway", "primary", "residential", "service")} AND NOT (highway = 'service' AND {IN("service", "parking_aisle", "drive-through", "driveway")}) AND NOT ({IN("access", "no", "private")} OR {IN("mv", "no", "private")} OR {IN("mc", "no", "private")}) AS drive FROM w
""")
def way_networks(spark, sf_dir):
    """Whether walkers, cars and through traffic may use each way."""
    c = F.col
    walk = rules.walkable(c("highway"), access=c("access"), foot=c("foot"), area=c("area"))
    car = rules.passable_by_car(c("highway"), access=c("access"), motor_vehicle=c("mv"), motorcar=c("mc"), service=c("service"), narrow=c("narrow"))
    drive = rules.drivable(c("highway"), classes=("primary", "residential", "service"), access=c("access"), motor_vehicle=c("mv"), motorcar=c("mc"), service=c("service"))
    return tags(spark, sf_dir).select("way", walk.alias("walk"), car.alias("car"), drive.alias("drive"))


@query("""
WITH s AS (SELECT s_suppkey AS site, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal / 400 END AS level, (s_suppkey * 7 % 11)::DOUBLE AS ground, s_suppkey % 5 AS kind, s_suppkey % 6 = 5 AS air FROM supplier), b AS (SELECT *, ([0, 0.01, 0.5, 2, 5]::DOUBLE[])[kind + 1] AS low, ([0, 0.5, 2, 5, 10]::DOUBLE[])[kind + 1] AS high FROM s)
SELECT site, CASE WHEN kind = 0 THEN 'outside' WHEN level IS NULL THEN 'unknown' WHEN level >= ground + high THEN 'yes' WHEN level < ground + low THEN 'no' ELSE 'class' END AS safe,
 CASE WHEN air THEN 0 WHEN level IS NOT NULL THEN round(greatest(0, level - ground), 2) ELSE high END AS climb FROM b
""")
def refuge_levels(spark, sf_dir):
    """Whether each refuge's level stays above the water of its class, and how high people climb there."""
    k, c = F.col("s_suppkey"), F.col
    s = table(spark, sf_dir, "supplier").select(k.alias("site"), F.when(k % 4 != 0, F.col("s_acctbal") / 400).alias("level"), (k * 7 % 11).cast("double").alias("ground"), (k % 5).cast("int").alias("kind"), (k % 6 == 5).alias("air"))
    bound = lambda *values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("kind") + 1)
    s = s.withColumns({"low": bound(0, 0.01, 0.5, 2, 5), "high": bound(0, 0.5, 2, 5, 10)})
    return s.select("site", rules.refuge_safety(c("kind"), c("level"), c("ground"), c("low"), c("high")).alias("safe"), rules.climb(c("level"), c("ground"), c("high"), c("air")).alias("climb"))


@query("""
WITH l AS (SELECT o_orderkey AS lot, CASE o_orderkey % 6 WHEN 0 THEN 'road ' WHEN 1 THEN 'water' WHEN 2 THEN 'strip-' WHEN 3 THEN 'x' ELSE '' END || o_custkey AS number FROM orders)
SELECT kind, count(*) AS lots FROM (SELECT CASE WHEN number LIKE 'road%' THEN 'road' WHEN number LIKE 'water%' THEN 'water' WHEN number LIKE 'strip%' THEN 'strip' WHEN number SIMILAR TO '[0-9].*' THEN 'private' ELSE 'other' END AS kind FROM l) GROUP BY kind
""")
def lot_kinds(spark, sf_dir):
    """Lots by the kind that their numbers begin with."""
    k = F.col("o_orderkey") % 6
    number = F.concat(F.when(k == 0, "road ").when(k == 1, "water").when(k == 2, "strip-").when(k == 3, "x").otherwise(""), F.col("o_custkey").cast("string"))
    kind = rules.lot_kind(number, [("road", "road"), ("water", "water"), ("strip", "strip")])
    return table(spark, sf_dir, "orders").select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("lots"))
