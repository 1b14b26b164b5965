"""Best states over pieces, and ways put end to end, against plain walks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessellum.operators import rasters
from tessellum.operators.joins import joined_ways
from tessellum.operators.rasters import best_states


def viterbi(rows, turn):
    """The cheapest states of one route; rows: for each sample the (state, cost) pairs in order."""
    best, back = [c for _, c in rows[0]], []
    for before, now in zip(rows, rows[1:], strict=False):
        step = [[b + turn * abs(s - t) for b, (t, _) in zip(best, before, strict=True)] for s, _ in now]
        back.append([x.index(min(x)) for x in step])
        best = [min(x) + c for x, (_, c) in zip(step, now, strict=True)]
    at, out = best.index(min(best)), []
    for k in range(len(rows) - 1, -1, -1):
        out.append(rows[k][at][0])
        at = back[k - 1][at] if k else 0
    return out[::-1]


@pytest.mark.parametrize("fan", [2, 3, 7, 500])
def test_pieces_change_nothing(spark, fan):
    r, routes = random.Random(4), {}
    for name, n in (("a", 40), ("b", 1), ("c", 7), ("d", 3), ("e", 29)):
        routes[name] = [(k * (1 + (name == "e")) - 5, [(float(s), r.uniform(0, 9)) for s in sorted(r.sample(range(12), r.randint(1, 5)))]) for k in range(n)]
    rows = [(k, seq, s, c) for k, own in routes.items() for seq, states in own for s, c in states]
    r.shuffle(rows)
    got = {}
    for x in best_states(spark.createDataFrame(rows, "route string, seq int, state double, cost double"), turn=0.8, fan=fan).orderBy("route", "seq").collect():
        got.setdefault(x.route, []).append((x.seq, x.state))
    assert got == {k: list(zip([s for s, _ in own], viterbi([x for _, x in own], 0.8), strict=True)) for k, own in routes.items()}


def test_no_samples(spark):
    assert best_states(spark.createDataFrame([], "route string, seq int, state double, cost double"), turn=1.0).count() == 0


def plain_chains(ways, gap):
    ends = {(w, k): p for w, p in ways.items() for k in (0, 1)}
    at = lambda e: ways[e[0]][2 * e[1] : 2 * e[1] + 2]
    near = {}
    for e in ends:
        d = min((math.dist(at(e), at(o)), o) for o in ends if o[0] != e[0])
        if d[0] <= gap:
            near[e] = d
    met = {e: d for e, d in near.items() if d[1] in near and near[d[1]][1] == e}
    seen, out = set(), set()
    for w in sorted(ways):
        if w in seen:
            continue
        # back from the way's beginning as far as it goes, then forward
        e, ring, n = (w, 0), False, 0
        while e in met:
            o = met[e][1]
            if o[0] == w and n:
                ring = True
                break
            e, n = (o[0], 1 - o[1]), n + 1
            if e[0] == w:
                ring = True
                break
        e = (w, 0) if ring else e
        chain, pos = w, 0
        come = met[e][0] if e in met else None
        while True:
            seen.add(e[0])
            out.add((chain, ring, pos, e[0], e[1] == 1, None if come is None else round(come, 9)))
            leave = (e[0], 1 - e[1])
            if leave not in met or (ring and met[leave][1][0] == w):
                break
            come, e = met[leave]
            pos += 1
    return out


def test_joined_ways(spark):
    r = random.Random(9)
    ways, n = {}, 0

    def put(points, closed=False):
        nonlocal n
        for a, b in [*zip(points, points[1:], strict=False), *([(points[-1], points[0])] if closed else [])]:
            jog = [c + r.uniform(-0.2, 0.2) for c in (*a, *b)]
            ways[(n * 37) % 101] = jog if r.random() < 0.5 else jog[2:] + jog[:2]
            n += 1

    put([(i * 5.0, 0.0) for i in range(12)])
    put([(math.cos(i) * 9, 40 + math.sin(i) * 9) for i in range(6)], closed=True)
    put([(0.0, 80.0), (6.0, 81.0)])
    put([(30.0, 80.0), (33.0, 84.0), (33.0, 90.0)])
    put([(60.0, 80.0), (63.0, 84.0)])
    frame = spark.createDataFrame([(k, *p) for k, p in ways.items()], "way long, x0 double, y0 double, x1 double, y1 double")
    got = {(x.chain, x.ring, x.pos, x.way, x.turned, None if x.gap is None else round(x.gap, 9)) for x in joined_ways(frame, gap=1.0).collect()}
    # an open chain is named by its least way, wherever that stands in it
    want = plain_chains(ways, 1.0)
    assert got == want and any(x[1] for x in want)
    assert joined_ways(frame.limit(0), gap=1.0).count() == 0


def test_pieces_are_taken_together(spark, monkeypatch):
    """Thousands of short routes are a few groups of bounded size, not a group each."""
    groups = []
    frame, grouping = type(spark.range(1)), type(spark.range(1).groupBy())
    group_by, run = frame.groupBy, grouping.applyInPandas

    def grouped(df, *cols):
        got = group_by(df, *cols)
        got._of = (df, cols)
        return got

    def seen(data, func, schema):
        df, cols = data._of
        groups.append((df.select(*cols).distinct().count(), df.count()))
        return run(data, func, schema)

    monkeypatch.setattr(frame, "groupBy", grouped)
    monkeypatch.setattr(grouping, "applyInPandas", seen)
    monkeypatch.setattr(rasters, "HELD", 1000)
    rows = spark.range(2000).select(F.col("id").cast("string").alias("route"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seq"), F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("state"))
    rows = rows.withColumn("cost", F.abs(F.col("state") - F.col("seq") % 2))
    got = best_states(rows, turn=0.4)
    assert got.groupBy("seq", "state").count().where("count = 2000").count() == 3
    # 6,000 samples of four numbers each in 24 groups of about 1,000 numbers
    assert max(n for n, _ in groups) == 24
