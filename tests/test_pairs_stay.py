"""Pairs that stay inside a task: results against plain loops, and how much is shuffled."""

import random
from statistics import median

import pytest

from tessellum.operators import documents, routing

from .test_related import plain


def shuffled(spark, run):
    """What a run returns, and how many bytes it has written to shuffles."""
    total = lambda: sum(e.totalShuffleWrite() for e in (spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0),))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = total()
    got = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return got, total() - before


def test_directness_of_places_that_all_differ(spark, monkeypatch):
    monkeypatch.setattr(routing, "PLACES", 90)
    r = random.Random(5)
    rows = [(k, r.randrange(4), r.uniform(0, 500), r.uniform(0, 500), float(r.randrange(70))) for k in range(1500)]
    rows += [(1500 + k, *rows[k][1:]) for k in range(40)] + [(1600, 2, None, 1.0, 0.0), (1601, None, 5.0, 1.0, 0.0), (1602, 1, 9e3, 9e3, 0.0), (1603, 1, 9e3, 9e3, None)]
    places = spark.createDataFrame(rows, "id long, node long, x double, y double, d double")
    moved = [(k, n, x if x is None or k % 9 else x + 40, y, d) for k, n, x, y, d in rows]
    targets = spark.createDataFrame(moved, places.schema)
    edges = spark.createDataFrame([(0, 1, 5.0), (1, 0, 7.0), (1, 2, 3.0), (2, 0, 90.0)], "u long, v long, w double")
    far = {(u, v): w for u, v, w in [(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 1, 5), (1, 0, 7), (1, 2, 3), (0, 2, 8), (2, 0, 90), (2, 1, 95)]}
    got, size = shuffled(spark, lambda: routing.directness(places, targets, edges, near=20.0, far=300.0, least=3).collect())
    met = [t for t in moved if None not in t and t[4] <= 60]
    want = {}
    for k, n, x, y, d in rows:
        pairs = [] if None in (n, x, d) or d > 60 else [(t, ((x - t[2]) ** 2 + (y - t[3]) ** 2) ** 0.5) for t in met if t[0] != k and (n, t[1]) in far]
        ratio = [(d + far[n, t[1]] + t[4]) / s for t, s in pairs if 20 <= s <= 300]
        want[k] = (len(ratio), None if d is not None and d > 60 else -1.0 if len(ratio) < 3 else round(median(ratio), 9))
    assert {x["id"]: (x["n"], x["directness"] if x["directness"] is None else round(x["directness"], 9)) for x in got} == want
    assert sum(n for n, _ in want.values()) > 500_000
    assert size < 4_000_000  # a row of each of the 700,000 pairs takes more


def test_items_that_all_differ_are_shuffled_once(spark, monkeypatch):
    r = random.Random(8)
    sold = spark.createDataFrame([(x, t) for x in range(600) for t in r.sample(range(900), 60)], "item long, t long")
    tags = spark.createDataFrame([(t, f"k{t % 90}") for t in range(900)], "t long, tag string")
    sizes, rows = [], []
    for own in (300, 30):
        monkeypatch.setattr(documents, "OWN", own)
        got, size = shuffled(spark, lambda: documents.related(sold, item="item", token="t", weight=2, limit=1, tags=tags).collect())
        rows.append(sorted(map(tuple, got)))
        sizes.append(size)
    assert len(rows[0]) == 600 and rows[0] == rows[1]
    assert sizes[1] < 2 * sizes[0]  # 20 blocks instead of 3, and no list is sent to every block


@pytest.mark.parametrize(("at_once", "strip", "common"), [(1, 1, 1000), (4, 3, 2), (10_000, 500, 0)])
def test_pairs_added_up_in_parts(spark, monkeypatch, at_once, strip, common):
    monkeypatch.setattr(documents, "AT_ONCE", at_once)
    monkeypatch.setattr(documents, "STRIP", strip)
    monkeypatch.setattr(documents, "OWN", 9)
    sold = [(x, t) for x in range(20) for t in range(12) if (x * 7 + t * 5) % 4 == 0]
    tags = [(t, f"k{t % 3}") for t in range(12)]
    got = documents.related(spark.createDataFrame(sold, "item long, t long"), item="item", token="t", weight=2, limit=3, tags=spark.createDataFrame(tags, "t long, tag string"), common=common)
    assert sorted(map(tuple, got.collect())) == sorted(plain(sold, tags, 2, 1, 3))
