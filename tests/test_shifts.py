"""Circular shifts by modular transforms against all shifts one by one."""

import random

import pytest

from tessellum.operators.statistics import correlations, shift_null


@pytest.mark.parametrize("n", [1, 2, 3, 37, 64, 300])
def test_all_shifts(spark, n):
    r = random.Random(n)
    a, b = [r.randrange(-10**6, 10**6) for _ in range(n)], [r.randrange(-999, 10**6) if r.random() < 0.8 else 0 for _ in range(n)]
    df = spark.createDataFrame(list(zip(range(n), a, b, strict=True)), "i long, a long, b long").repartition(3)
    got = {x.k: x.t for x in correlations(df, at="i", a="a", b="b").collect()}
    t = [sum(a[i] * b[(i + k) % n] for i in range(n)) for k in range(n)]
    assert got == dict(enumerate(t))
    one = shift_null(df, at="i", a="a", b="b").first()
    assert abs(one.observed - t[0] / n) <= 1e-12 * abs(t[0]) and one.p == (sum(x >= t[0] for x in t[1:]) + 1) / n


def test_decimals_and_limits(spark):
    df = spark.createDataFrame([(0, 0.1, 2.0), (1, 0.2, 2.0), (2, 0.7, 2.0)], "i long, a double, b double")
    one = shift_null(df, at="i", a="a", b="b", decimals=(1, 0)).first()  # all shifts tie, as they do on whole numbers
    assert abs(one.observed - 2 / 3) < 1e-12 and one.p == 1
    with pytest.raises(ValueError):
        correlations(df.selectExpr("i", "cast(a * 1e10 as long) a", "cast(b * 1e10 as long) b"), at="i", a="a", b="b")
    assert correlations(df.where("i > 9").selectExpr("i", "0L a", "0L b"), at="i", a="a", b="b").count() == 0
