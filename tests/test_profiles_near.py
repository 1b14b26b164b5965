"""What lies beside lines, by cells and ranges, against all pairs."""

import math
import random

import numpy as np

from tessellum.operators import profiles as P


def test_along_and_off(spark):
    r = random.Random(3)
    lines = {k: [(r.uniform(0, 300), r.uniform(0, 200)) for _ in range(r.randint(2, 7))] for k in range(6)}
    places = [(i, r.uniform(-20, 320), r.uniform(-20, 220)) for i in range(60)]
    df = spark.createDataFrame([(k, i, *p) for k, own in lines.items() for i, p in enumerate(own)], "k int, i int, x double, y double")
    from tessellum.operators.profiles import measured

    got = {(x.id, x.k): (x.along, x.off) for x in P.along_and_off(spark.createDataFrame(places, "id int, x double, y double"), measured(df, key="k", order="i"), place="id", key="k", reach=25.0).collect()}
    want = {}
    for i, x, y in places:
        for k, own in lines.items():
            best, d = (math.inf, 0.0), 0.0
            for (ax, ay), (bx, by) in zip(own, own[1:], strict=False):
                n = math.dist((ax, ay), (bx, by))
                f = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / (n * n)))
                best = min(best, (math.dist((x, y), (ax + (bx - ax) * f, ay + (by - ay) * f)), d + n * f))
                d += n
            if best[0] <= 25:
                want[i, k] = (best[1], best[0])
    assert got.keys() == want.keys() and want and all(math.dist(got[k], want[k]) < 1e-9 for k in want)


def test_interpolated(spark):
    r = random.Random(5)
    ref = [(float(a), r.uniform(0, 9)) for a in sorted(r.sample(range(100), 20))]
    rows = [(i, r.choice([r.uniform(-10, 110), r.choice(ref)[0]])) for i in range(80)] + [(900, None), (901, 5.0), (901, 5.0)]
    df = spark.createDataFrame(rows, "id int, at double").repartition(3)
    got = P.interpolated(spark.createDataFrame(ref, "at double, v double"), df, at="at", value="v").collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"id", "at", "reference"}
    for x in got:
        if x["at"] is None:
            assert x.reference is None
        else:
            assert abs(x.reference - np.interp(x["at"], *zip(*ref, strict=True))) < 1e-9
    none = P.interpolated(spark.createDataFrame([], "at double, v double"), df, at="at", value="v").collect()
    assert len(none) == len(rows) and all(x.reference is None for x in none)


def test_signed_offsets(spark):
    r = random.Random(6)
    front = [(i, 10.0 * i, 40 + 30 * math.sin(i / 3)) for i in range(30)]
    points = [(i, r.uniform(-20, 320), r.uniform(-20, 120)) for i in range(70)]
    got = {x.id: (x.offset, x.inside) for x in P.signed_offsets(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(front, "i int, x double, y double"), pid="id", order="i").collect()}
    low, high = min(f[2] for f in front) - 5, max(f[2] for f in front) + 5
    for i, x, y in points:
        k = min(range(30), key=lambda k, x=x, y=y: (math.dist((x, y), front[k][1:]), k))
        a, b = front[max(k - 1, 0)], front[min(k + 1, 29)]
        dx, dy = b[1] - a[1], b[2] - a[2]
        off = ((x - front[k][1]) * dy - (y - front[k][2]) * dx) / math.hypot(dx, dy)
        assert abs(got[i][0] - off) < 1e-9 and got[i][1] == (low <= y <= high)
    assert len(got) == len(points)
