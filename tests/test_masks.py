"""Distances, growth, majorities and holes on sparse random grids, cell by cell."""

import math
import random

import numpy as np

from tessellum.operators import masks as M


def cells(seed, share=0.9):
    r = random.Random(seed)
    return [(a - 4, b + 2) for a in range(17) for b in range(23) if r.random() < share]


def test_envelope_is_exact():
    r = np.random.default_rng(3)
    for _ in range(200):
        rows = np.unique(r.integers(-30, 30, 12)).astype(float)
        squares = r.integers(0, 20, len(rows)).astype(float) ** 2
        asked = np.arange(-40, 40).astype(float)
        want = [min((a - x) ** 2 + s for x, s in zip(rows, squares, strict=True)) for a in asked]
        assert M._envelope(rows, squares, asked).tolist() == want


def test_distances_and_growth(spark):
    over, r = cells(1), random.Random(2)
    sources = [(r.randrange(3), *k) for k in cells(5, 0.05)] + [(0, 40, 40), (0, 40, 40)]
    s = spark.createDataFrame(sources, "kind int, r int, c int")
    o = spark.createDataFrame(over, "r int, c int")
    d2 = {(k, *a): min((a[0] - y) ** 2 + (a[1] - x) ** 2 for kind, y, x in sources if kind == k) for k in {x[0] for x in sources} for a in over}
    assert {(x.kind, x.r, x.c): x.d2 for x in M.square_distances(s, o).collect()} == d2
    near = {a: min((d2[k, *a], k) for k in range(3) if (k, *a) in d2) for a in over}
    assert {(x.r, x.c): (x.d2, x.kind) for x in M.grown(s, o, reach=3.0).collect()} == {a: n for a, n in near.items() if n[0] <= 9}
    cut = {(x.r, x.c): x.dist for x in M.distances(s.select("r", "c"), o, limit=2.5).collect()}
    assert cut == {a: min(2.5, math.sqrt(n[0])) for a, n in near.items()}
    assert M.distances(s.where("kind > 9").select("r", "c"), o).count() == 0 and M.distances(s.select("r", "c"), o.limit(0)).count() == 0


def test_majorities(spark):
    r = random.Random(4)
    known = {k: r.randrange(4) for k in cells(7, 0.5)}
    empty = [k for k in cells(8, 1.0) if k not in known]

    def most(now, k, half):
        found = [now[a, b] for a in range(k[0] - half, k[0] + half + 1) for b in range(k[1] - half, k[1] + half + 1) if (a, b) in now]
        return min(((-found.count(x), x) for x in set(found)), default=(0, None))

    now, left = dict(known), set(empty)
    for _ in range(3):
        new = {k: m[1] for k in left if -(m := most(now, k, 2))[0] >= 5}
        now |= new
        left -= new.keys()
    frame = spark.createDataFrame([(*k, v) for k, v in known.items()], "r int, c int, kind int")
    got = M.majority_filled(frame, spark.createDataFrame(empty, "r int, c int"), size=5, least=5, rounds=3)
    assert {(x.r, x.c): x.kind for x in got.collect()} == now
    want = {k: m[1] if -(m := most(known, k, 1))[0] >= 3 else v for k, v in known.items()}
    assert {(x.r, x.c): x.kind for x in M.smoothed_classes(frame, size=3, least=3).collect()} == want


def test_holes(spark):
    for share in (0.5, 0.62, 0.8):
        mask = set(cells(11, share))
        rows, cols = [k[0] for k in mask], [k[1] for k in mask]
        frame = {(a, b) for a in range(min(rows) - 1, max(rows) + 2) for b in range(min(cols) - 1, max(cols) + 2)} - mask
        todo, outside = [(min(rows) - 1, min(cols) - 1)], set()
        while todo:
            k = todo.pop()
            if k in frame and k not in outside:
                outside.add(k)
                todo += [(k[0] + a, k[1] + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]
        df = spark.createDataFrame(list(mask), "r int, c int")
        assert {(x.r, x.c) for x in M.holes(df).collect()} == frame - outside
        assert M.filled(df).count() == len(mask) + len(frame - outside)
    assert M.holes(df.limit(0)).count() == 0
