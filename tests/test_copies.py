"""Steps whose work must not grow with the square of the input, on tables of copies that stand at the same places."""

import pytest
from pyspark.sql import functions as F

from tessellum.operators import gate, joins, routing, spatial
from tessellum.plans import registry, stages

SMALL = "/root/testdata/sf0.001"
#: A shift that leaves places, courses, codes and nodes as they are.
SHIFT = 18_000


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):
    """A folder of tables in which customers and suppliers are there four times."""
    at = tmp_path_factory.mktemp("copied")
    for name in ("nation", "region", "orders", "lineitem", "part", "customer", "supplier"):
        df = spark.read.parquet(f"{SMALL}/{name}.parquet")
        key = {"customer": "c_custkey", "supplier": "s_suppkey"}.get(name)
        if key:
            df = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn(key, F.col(key) + F.col("i") * SHIFT).drop("i")
        df.write.parquet(f"{at}/{name}.parquet")
    return str(at)


def met(monkeypatch, run):
    """Rows of a query, and how many pairs of places all its joins by distance have made."""
    pairs, own = [], spatial.within

    def counted(*args, **kw):
        got = own(*args, **kw)
        pairs.append(got.count())
        return got

    for module in (spatial,):
        monkeypatch.setattr(module, "within", counted)
    return run().collect(), sum(pairs)


@pytest.mark.parametrize("name", ["radius_count", "vote_list", "local_direction", "angular_match", "nearest_join", "truncated_chamfer", "directness"])
def test_copies_make_no_pairs(spark, copied, monkeypatch, name):
    run = registry.queries()[name]
    _, few = met(monkeypatch, lambda: run(spark, SMALL))
    monkeypatch.undo()
    _, many = met(monkeypatch, lambda: run(spark, copied))
    assert many <= few + 20


def test_close_places_are_looked_up_by_small_cells(spark, monkeypatch):
    k = F.col("id")
    p = spark.range(2000).select(k, (k * 37 % 2000 / 2000).alias("x"), (k * 53 % 2000 / 2000).alias("y"))
    got, pairs = met(monkeypatch, lambda: spatial.nearest(p, p.select(F.col("id").alias("sid"), F.col("x") + 0.0001, "y") .toDF("sid", "x", "y"), lid="id", rid="sid", size=300.0))
    assert len(got) == 2000 and all(r["id"] == r["sid"] for r in got)
    assert pairs < 200_000  # 4,000,000 with cells of 300


def test_nearest_by_condition_and_reach(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0), (2, 0.0, 0.0, 1), (3, 50.0, 0.0, 0)], "id long, x double, y double, c int")
    s = spark.createDataFrame([(9, 1.0, 0.0, 1), (8, 1.0, 0.0, 1), (7, 3.0, 0.0, 0), (6, 100.0, 0.0, 0)], "sid long, x double, y double, o int")
    got = spatial.nearest(p, s, lid="id", rid="sid", size=1.0, reach=4.0, own=("c",), other=("o",), where=F.col("c") == F.col("o"))
    assert sorted((r["id"], r["sid"]) for r in got.collect()) == [(1, 7), (2, 8)]


def test_an_id_is_never_its_own_target(spark):
    rows = [(k, 0, float(k % 2), 0.0, 0.0) for k in range(4)]
    places = spark.createDataFrame(rows, "id long, node long, x double, y double, d double")
    edges = spark.createDataFrame([(0, 1, 1.0)], "u long, v long, w double")
    got = routing.directness(places, places.withColumn("x", F.col("x") + 5), edges, near=1.0, far=100.0, least=1)
    assert {r["id"]: r["n"] for r in got.collect()} == {k: 3 for k in range(4)}


def test_limits_of_a_section_are_brought_down_before_routes_meet_them(spark):
    steps = spark.createDataFrame([(1, 5), (2, 5)], "route long, section long")
    closures = spark.createDataFrame([(5, 300.0, 9, 4), (5, 300.0, 7, None), (5, 10.0, 1, 1)], "section long, length double, mm int, hr int")
    got = gate.least_threshold(steps, closures, route="route", section="section")
    assert sorted(map(tuple, got.collect())) == [(1, 7, 4), (2, 7, 4)]
    joined = got._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]
    assert joined.count("Aggregate [section") >= 1 and "min(" in joined


def test_what_grows_is_not_broadcast(spark, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    p = spark.range(500).select(F.col("id").alias("p"), (F.col("id") % 50).cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    assert "Broadcast" not in plan(spatial.within(p, p.withColumnRenamed("p", "q"), lid="p", rid="q", radius=1.0))
    ways = spark.range(60).select(F.col("id").alias("way"), (F.col("id") * 10.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("id") * 10.0 + 9.6).alias("x1"), F.lit(0.0).alias("y1"))
    monkeypatch.setattr(stages, "BROADCAST_BYTES", 0)
    got = joins.joined_ways(ways, gap=1.0)
    assert "Broadcast" not in plan(got)
    assert sorted((r["chain"], r["way"], r["pos"]) for r in got.collect()) == [(0, k, k) for k in range(60)]
