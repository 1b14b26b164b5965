"""Exact means, vectors with copies, and what is worked out once."""

import random

from pyspark.sql import functions as F

from tessellum.operators import documents, graph, joins, profiles, vectors
from tessellum.plans import registry


def test_nearest_vectors_with_copies_and_unknown_ones(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 60)
    r = random.Random(3)
    rows = [(k, [float(r.randrange(4)) for _ in range(3)]) for k in range(80)] + [(k, [9.0, 9.0, -0.0 if k % 2 else 0.0]) for k in range(80, 100)] + [(100, None), (101, [1.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    got = {x["id"]: x["other"] for x in vectors.nearest_vectors(v, v.where("id % 5 = 0")).collect()}
    inf = float("inf")
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) if a and b and len(a) == len(b) == 3 else inf
    assert got == {k: min((far(v, w), j) for j, w in rows if j != k)[1] for k, v in rows if k % 5 == 0}


def test_a_mean_at_the_bound_is_not_below_it(spark, tmp_path):
    # the mean of these is just 0.049, and sums of doubles in any order are less
    rows = [("A", "F", 1, x, 1.0) for x in (0.06, 0.09, 0.0, 0.07, 0.04, 0.034)]
    low = [("A", "F", 3, 0.04, 3.0)]
    spark.createDataFrame(rows + low, "l_returnflag string, l_linestatus string, l_suppkey long, l_discount double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["best_band"](spark, str(tmp_path)).first()
    assert (got["cls"], got["q"], got["lo"], got["hi"], got["robust"]) == ("F", 0.04, 3.0, 6.0, 1)


def joined_rows(df, monkeypatch=None):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_canonical_chains_of_copies(spark):
    rows = [(k, k % 2, 1, 100.0 + (k % 3) * 9, "m") for k in range(12)] + [(20, 0, 1, 500.0, "m"), (21, None, 1, 5.0, "m")]
    c = spark.createDataFrame(rows, "id long, a int, b int, n double, m string")
    df = profiles.canonical(c, chain="id", a="a", b="b", length="n", same="m")
    want = {k: min([j for j, *o in rows if None not in (a, o[0]) and {a, b} == {o[0], o[1]} and j < k and abs(o[2] - n) < 0.1 * n], default=k) for k, a, b, n, _ in rows}
    assert {r["id"]: r["canon"] for r in df.collect()} == want
    # chains alike are one row before they are joined with others
    assert joined_rows(df).count("Aggregate [p") >= 3


def test_edges_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def told(x):
        seen.add(1)
        return x

    told = told.asNondeterministic()
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 2.0)], "u long, v long, w double").withColumn("u", told("u"))
    assert graph.simple_paths(edges, start=0, end=2, stretch=1.5).count() == 2
    assert seen.value == 3


def test_work_is_dealt_by_key_before_it_grows(spark):
    p = spark.range(200_000).select(F.col("id").alias("k"), (F.col("id") % 100).alias("x"))
    labels = spark.createDataFrame([(1, 10.0), (2, 90.0)], "name int, at double")
    df = joins.nearest_label(p, labels, key="k", name="name", distance=F.abs(F.col("x") - F.col("at")), weight=F.lit(1.0))
    # the shuffle lies below the join: none of the rows of point and label is moved
    assert joined_rows(df).index("Join") < joined_rows(df).index("RepartitionByExpression")
    assert df.where("name = 1").count() == 200_000 // 100 * 51


def test_pairs_are_dealt_by_the_number_of_rows(spark):
    items = spark.range(2_600_000).select((F.col("id") % 1_300_000).alias("g"), (F.col("id") % 7).alias("i"))
    df = documents.cooccurrence(items, group="g", item="i")
    assert "RepartitionByExpression [a" in joined_rows(df) and ", 5" in joined_rows(df)
