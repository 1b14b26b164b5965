"""Drainage in tiles of several sizes against one global solution from the definition."""

import math
import random

import pytest

from tessellum.operators.drainage import drainage

NEAR = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def plain(v):
    near = lambda k: [n for a, b in NEAR if (n := (k[0] + a, k[1] + b)) in v]
    rim = {k for k in v if len(near(k)) < 8}
    level = {k: h if k in rim else math.inf for k, h in v.items()}
    changed = True
    while changed:
        changed = False
        for k in v:
            low = max(v[k], min((level[n] for n in near(k)), default=math.inf))
            if low < level[k]:
                level[k], changed = low, True
    d = {k: 0 for k in v if k in rim or any(level[n] < level[k] for n in near(k))}
    now = list(d)
    while now:
        then = []
        for k in now:
            for n in near(k):
                if level[n] == level[k] and n not in d:
                    d[n] = d[k] + 1
                    then.append(n)
        now = then
    to = {k: min(near(k), key=lambda n: (level[n], d[n], n)) for k in v if k not in rim}
    cells = dict.fromkeys(v, 1)
    for k in v:
        while k in to:
            k = to[k]
            cells[k] += 1
    return {k: (*to.get(k, (-1, -1)), cells[k], level[k]) for k in v}


def made(kind):
    r = random.Random(kind)
    if kind == "lakes":
        return {(a, b): float(r.choice([1, 1, 2, 3, 9]) + (6 if min(a, b) == 3 else 0)) for a in range(24) for b in range(22)}
    if kind == "bowl":
        return {(a, b): float((a - 11) ** 2 + (b - 10) ** 2) if r.random() < 0.9 else 400.0 for a in range(23) for b in range(21) if (a, b) != (0, 0)}
    return {(a - 5, b + 3): r.uniform(0, 90) for a in range(20) for b in range(25) if r.random() < 0.985}


@pytest.mark.parametrize(("kind", "size"), [("lakes", 3), ("lakes", 12), ("lakes", 64), ("bowl", 3), ("rough", 3), ("rough", 13)])
def test_tiles_change_nothing(spark, kind, size):
    v = made(kind)
    rows = [("a", *k, x) for k, x in v.items()] + [("b", *k, float(k[0])) for k in v if k[0] < 2] + [("a", 900, 900, None), ("c", 0, 0, 1.0)]
    got = {(r.grid, r.r, r.c): (r.to_r, r.to_c, r.cells, r.level) for r in drainage(spark.createDataFrame(rows, "grid string, r int, c int, v double"), size=size).collect()}
    want = {(g, *k): x for g, own in (("a", v), ("b", {k: float(k[0]) for k in v if k[0] < 2}), ("c", {(0, 0): 1.0})) for k, x in plain(own).items()}
    assert got == want


def test_no_cells(spark):
    assert drainage(spark.createDataFrame([], "grid string, r int, c int, v double")).count() == 0
