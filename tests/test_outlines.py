"""Rings, contour lines and simplified lines against plain walks."""

import json
import math
import random

from pyspark.sql import functions as F

from tessellum.operators import chains
from tessellum.operators import rings as R
from tessellum.plans import outlines as P

SF = "/root/testdata/sf0.001"


def turned(points):
    k = points.index(min(points))
    return tuple(points[k:] + points[:k])


def walked(edges):
    """Rings of directed edges, at each corner along the edge that turns most to the left."""
    left, out = set(edges), set()
    while left:
        e = first = min(left)
        way = []
        while True:
            left.discard(e)
            way.append(e[0])
            back = math.atan2(e[0][1] - e[1][1], e[0][0] - e[1][0])
            e = min((x for x in edges if x[0] == e[1]), key=lambda x: (back - math.atan2(x[1][1] - x[0][1], x[1][0] - x[0][0])) % (2 * math.pi))
            if e == first:
                break
        out.add(turned(way))
    return out


def of(df, group):
    got = {}
    for r in df.orderBy("ring", "pos").collect():
        got.setdefault((r[group], r.ring), []).append(((r.x0, r.y0), (r.x1, r.y1)))
    for own in got.values():
        assert all(a[1] == b[0] for a, b in zip(own, own[1:] + own[:1], strict=True))
    return {(k, tuple(a for a, _ in own)) for (k, _), own in got.items()}


def cell_rim(cells):
    sides = [(((c, r), (c + 1, r)), ((c + 1, r), (c + 1, r + 1)), ((c + 1, r + 1), (c, r + 1)), ((c, r + 1), (c, r))) for r, c in cells]
    every = {e for s in sides for e in s}
    return {e for e in every if (e[1], e[0]) not in every}


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def inside(p, ring):
    return sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1


def test_rings_of_random_cells(spark):
    r = random.Random(5)
    kinds = {(a, b): r.choice([0, 0, 0, 1, 2]) for a in range(12) for b in range(11) if r.random() < 0.95}
    cells = spark.createDataFrame([(*k, v) for k, v in kinds.items()], "r long, c long, kind int")
    rings = R.stash(R.rings(R.outline(R.cell_edges(cells, group="kind"), group="kind"), group="kind"), "rings")
    want = {(k, ring) for k in range(3) for ring in walked(cell_rim([x for x, v in kinds.items() if v == k]))}
    assert of(rings, "kind") == want
    # every hole lies in the least of the outer rings around it
    named = {(x.kind, x.ring): (x.x0, x.y0) for x in rings.where("pos = 0").collect()}
    own = {}
    for k, ring in want:
        own.setdefault(k, []).append(ring)
    got = {(x.kind, named[x.kind, x.hole], named[x.kind, x.ring]) for x in R.holes_of(rings, group="kind", bucket=3.0).collect()}
    least = set()
    for k, listed in own.items():
        for h in listed:
            if area(h) < 0:
                (x0, y0), (x1, y1) = h[:2]
                p = ((x0 + x1) / 2 - (y1 - y0) * 1e-6, (y0 + y1) / 2 + (x1 - x0) * 1e-6)
                least.add((k, h[0], min((area(o), o) for o in listed if area(o) > 0 and inside(p, o))[1][0]))
    assert got == least and least
    straight = of(R.straight(rings, group="kind"), "kind")
    bend = lambda ring: tuple(b for a, b, c in zip(ring[-1:] + ring[:-1], ring, ring[1:] + ring[:1], strict=True) if (b[0] - a[0]) * (c[1] - b[1]) != (b[1] - a[1]) * (c[0] - b[0]))
    assert straight == {(k, bend(ring)) for k, ring in want}
    for row in R.as_features(rings, group="kind", bucket=3.0).collect():
        shape = json.loads(row.geometry)
        assert shape["type"] == "MultiPolygon" and sum(area(tuple(map(tuple, g[:-1]))) for p in shape["coordinates"] for g in p) == sum(v == row.kind for v in kinds.values())
        assert all(g[0] == g[-1] for p in shape["coordinates"] for g in p) and all(area(tuple(map(tuple, p[0][:-1]))) > 0 for p in shape["coordinates"])


def test_zone_polygons(spark):
    sides = P.parcels(spark, SF).collect()
    rings = {}
    for s in sides:
        rings.setdefault((s.zone, s.id), []).append(((s.x0, s.y0), (s.x1, s.y1)))
    edges = {}
    for (zone, _), own in rings.items():
        if sum(a[0] * b[1] - b[0] * a[1] for a, b in own) < 0:
            own = [(b, a) for a, b in own]
        for e in own:
            edges.setdefault(zone, set()).add(e)
    want = []
    for zone, own in edges.items():
        want += [(zone, *ring[0], len(ring), round(area(ring), 4)) for ring in walked({e for e in own if (e[1], e[0]) not in own})]
    got = P.zone_polygons(spark, SF).collect()
    assert sorted((r.zone, r.x, r.y, r.n, r.area) for r in got) == sorted(want) and all((r.area < 0) == (r.outer_x is not None) for r in got)


def test_contour_lines_are_whole(spark):
    r = random.Random(6)
    v = {(a, b): r.uniform(0, 50) for a in range(14) for b in range(13)}
    v[3, 3] = v[3, 4] = 25.0  # the level itself
    cells = spark.createDataFrame([(*k, x) for k, x in v.items()], "r long, c long, v double")
    got = {}
    for x in R.contour_lines(cells, levels=[25.0]).orderBy("line", "pos").collect():
        got.setdefault((x.line, x.closed), []).append(((x.x0, x.y0), (x.x1, x.y1)))
    pieces = 0
    for (_, closed), own in got.items():
        pieces += len(own)
        assert all(math.dist(a[1], b[0]) < 1e-9 for a, b in zip(own, own[1:], strict=False))
        if closed:
            assert math.dist(own[-1][1], own[0][0]) < 1e-9
        else:
            assert all(min(x, y) < 1e-9 or x > 12 - 1e-9 or y > 13 - 1e-9 for x, y in (own[0][0], own[-1][1]))
    want = 0
    for a in range(13):
        for b in range(12):
            high = [v[a, b] >= 25, v[a, b + 1] >= 25, v[a + 1, b + 1] >= 25, v[a + 1, b] >= 25]
            want += sum(high[k] != high[k - 1] for k in range(4)) // 2
    assert pieces == want and any(c for _, c in got) and not all(c for _, c in got)


def plain_simplified(pts, tolerance):
    if len(pts) < 3:
        return pts
    (ax, ay), (bx, by) = pts[0][1:], pts[-1][1:]
    size = (bx - ax) ** 2 + (by - ay) ** 2

    def far(p):
        t = max(0.0, min(1.0, ((p[1] - ax) * (bx - ax) + (p[2] - ay) * (by - ay)) / size)) if size else 0.0
        return math.hypot(p[1] - ax - t * (bx - ax), p[2] - ay - t * (by - ay))

    k = max(range(1, len(pts) - 1), key=lambda i: (far(pts[i]), -i))
    return plain_simplified(pts[: k + 1], tolerance)[:-1] + plain_simplified(pts[k:], tolerance) if far(pts[k]) > tolerance else [pts[0], pts[-1]]


def test_simplified(spark):
    r = random.Random(7)
    lines = {1: [(0.0, 0.0)], 2: [(0.0, 0.0), (5.0, 5.0)], 3: [(float(i), math.sin(i / 5) * 9) for i in range(120)], 4: [(math.cos(i / 16 * math.pi) * 5, math.sin(i / 16 * math.pi) * 5) for i in range(33)], 5: [(1.0, 1.0)] * 6}
    x = y = 0.0
    walk = lines.setdefault(6, [])
    for _ in range(150):
        x, y = x + r.uniform(-1, 2), y + r.uniform(-1, 1)
        walk.append((x, y))
    rows = [(k, i, *p) for k, own in lines.items() for i, p in enumerate(own)]
    got = R.simplified(spark.createDataFrame(rows, "line int, pos int, x double, y double"), tolerance=0.8).collect()
    want = {(k, p[0]) for k, own in lines.items() for p in plain_simplified([(i, *q) for i, q in enumerate(own)], 0.8)}
    assert {(r.line, r.pos) for r in got} == want and len(got) == len(want)


def test_simplified_contours_stay_within_tolerance(spark):
    got = P.simplified_contours(spark, SF).collect()
    assert got and all(2 <= r.kept <= r.n for r in got)


def test_empty(spark):
    none = spark.createDataFrame([], "r long, c long, v double, kind int")
    assert R.rings(R.outline(R.cell_edges(none, group="kind"), group="kind"), group="kind").count() == 0
    assert R.contour_lines(none, levels=[1.0]).count() == 0
    assert R.simplified(spark.createDataFrame([], "line int, pos int, x double, y double"), tolerance=1.0).select(F.count("*")).first()[0] == 0


def test_rings_within_a_strip_are_left_out_of_the_rounds(spark, monkeypatch):
    seen, own = [], chains.follow
    monkeypatch.setattr(chains, "follow", lambda links, **kw: seen.append(links.count()) or own(links, **kw))
    cells = spark.range(3000).select(F.col("id").alias("r"), (F.col("id") % 2 * 2).alias("c"), F.lit(1).alias("kind"))
    got = R.ring_measures(R.rings(R.outline(R.cell_edges(cells, group="kind"), group="kind"), group="kind"), group="kind")
    assert got.where("area = 1 AND length = 4 AND n = 4").count() == 3000
    # only rings at the borders of strips, of 12,000 edges
    assert sum(seen) < 100
