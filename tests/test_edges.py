"""What the newer operators give for empty tables, nulls and the smallest inputs."""

import math

from pyspark.sql import functions as F

from tessellum.functions import rules
from tessellum.operators import graph, slopes, terrain

PROFILE = "k int, s double, z double, wet boolean, high boolean, curve double"


def test_slopes_of_little(spark):
    none = spark.createDataFrame([], PROFILE)
    assert slopes.hinge(none, by="k", s="s", z="z").count() == 0 and slopes.feet(none, by="k", ds=0.5).count() == 0
    short = spark.createDataFrame([(1, 0.0, 1.0, False, True, None), (1, 5.0, None, None, None, 1.0), (2, 1.0, 2.0, True, False, 0.0)], PROFILE)
    got = {r.k: r for r in slopes.feet(short, by="k", ds=0.5).collect()}
    assert got[1].mountain == got[1].foot == 0.25 and got[1].range == 0 and not got[1].complete
    assert got[2].foot is None and got[2].range is None and got[2].plain is None
    assert slopes.agreement(slopes.feet(short, by="k", ds=0.5)).count() == 0


def test_hinge_finds_a_made_knee(spark):
    rows = [(k, i * 0.5, 40 - 1.5 * min(i * 0.5, 20.0 + k) + 0.1 * max(0.0, i * 0.5 - 20.0 - k) + 1000.0, False, False, None) for k in range(3) for i in range(90)]
    for r in slopes.hinge(spark.createDataFrame(rows, PROFILE).repartition(5), by="k", s="s", z="z").collect():
        assert r.knee == 20 + r.k and r.rms < 1e-4 and abs(r.up + 1.5) < 1e-6 and abs(r.down - 0.1) < 1e-6


def test_centre_line_of_little(spark):
    schema = "row long, a double, b double"
    assert slopes.centre_line(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(4, 0.0, 1.0), (4, 5.0, 9.0), (7, 0.0, 2.0), (7, 6.5, 7.0), (8, 3.0, 3.0)], schema)
    assert sorted(map(tuple, slopes.centre_line(rows).collect())) == [(4, 7.0), (7, 6.75)]
    assert sorted(map(tuple, slopes.centre_line(rows, start=0.0).collect())) == [(4, 0.5), (7, 1.0)]


def test_relief_of_little(spark):
    schema = "r long, c long, v double"
    assert terrain.hill_shade(spark.createDataFrame([], schema)).count() == 0
    assert terrain.hill_shade(spark.createDataFrame([(0, 0, 1.0)], schema)).count() == 0  # no neighbour, no gradient
    plane = spark.createDataFrame([(r, c, 2.0 * c) for r in range(5) for c in range(6)], schema)
    got = terrain.curvatures(plane).collect()
    assert len(got) == 30 and all(abs(x.slope - math.degrees(math.atan(2))) < 1e-9 and abs(x.profile) < 1e-9 and abs(x.plan) < 1e-9 for x in got)
    flat = terrain.curvatures(plane.withColumn("v", F.lit(1.0))).collect()
    assert all(x.slope == 0 and x.profile is None and x.plan is None for x in flat)


def test_rules_without_tags(spark):
    c = F.col
    tags = "highway string, access string, foot string, area string, mv string, mc string, service string, narrow boolean"
    df = spark.createDataFrame([(None,) * 8, ("primary", *[None] * 7), ("footway", "no", "yes", *[None] * 5)], tags)
    walk = rules.walkable(c("highway"), access=c("access"), foot=c("foot"), area=c("area"))
    car = rules.passable_by_car(c("highway"), access=c("access"), motor_vehicle=c("mv"), motorcar=c("mc"), service=c("service"), narrow=c("narrow"))
    assert [tuple(r) for r in df.select(walk, car).collect()] == [(True, False), (True, True), (True, False)]
    lots = spark.createDataFrame([(None,), ("",), ("7-1",), ("roadside",)], "n string").select(rules.lot_kind(c("n"), [("road", "road")]).alias("k"))
    assert [r.k for r in lots.collect()] == ["other", "other", "private", "road"]


def test_bridges_of_nothing(spark):
    none = spark.createDataFrame([], "u long, v long")
    weights = spark.createDataFrame([], "node long, weight double")
    assert graph.bridges(none, weights, root=1).count() == 0
    loops = spark.createDataFrame([(1, 1), (2, 3), (3, 2)], "u long, v long")
    assert graph.bridges(loops, weights, root=1).count() == 0
    assert [tuple(r) for r in graph.bridges(spark.createDataFrame([(2, 3)], "u long, v long"), weights, root=1).collect()] == [(2, 3, 0.0)]
