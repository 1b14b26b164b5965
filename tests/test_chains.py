"""List ranking, ways up a forest and running sums against plain walks."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessellum.operators import chains as C


def test_chains_and_rings(spark):
    r = random.Random(2)
    ids, links, want = r.sample(range(10**6), 200), [], {}
    for size, ring in ((2, True), (50, True), (70, False), (37, True), (1, True), (3, False), (2, False)):
        own = [ids.pop() for _ in range(size)]
        links += [*itertools.pairwise(own), *([(own[-1], own[0])] if ring else [])]
        k = own.index(min(own)) if ring else 0
        want |= {x: (min(own), ring, i) for i, x in enumerate(own[k:] + own[:k])}
    got = C.chains(spark.createDataFrame(links, "node long, to long")).collect()
    assert {x.node: (x.chain, x.ring, x.pos) for x in got} == want and len(got) == len(want)
    assert C.chains(spark.createDataFrame([], "node long, to long")).count() == 0


def forest(n=120):
    r = random.Random(4)
    up = {i: r.randrange(max(0, i - 5), i) for i in range(1, n)} | {1000: 1001}

    def way(x):
        return [x, *(way(up[x]) if x in up else [])]

    return up, way


def test_follow(spark):
    up, way = forest()
    got = C.follow(spark.createDataFrame([(a, b, a) for a, b in up.items()], "node long, to long, w long"), sums=("w",)).collect()
    assert {r.node: (r.to, r.steps, r.w) for r in got} == {a: (way(a)[-1], len(way(a)) - 1, sum(way(a)[:-1])) for a in up}
    with pytest.raises(RuntimeError):
        C.follow(spark.createDataFrame([(1, 2), (2, 1)], "node long, to long"), most_rounds=4)


def test_ancestors_of_any_depth(spark):
    up, way = forest()
    asked = {k: n for k, n in enumerate([119, 60, 3, 0, 1000, 7, 8, 9, 10, 12, 20])}
    got = {}
    for r in C.ancestors(spark.createDataFrame(list(up.items()), "node long, to long"), spark.createDataFrame(list(asked.items()), "route int, node long")).collect():
        got.setdefault(r.route, {})[r.step] = r["at"]
    assert got == {k: dict(enumerate(way(n))) for k, n in asked.items()}


def test_running_sums(spark):
    r = random.Random(9)
    rows = [(i, i * 7919 % 1009, r.randrange(-99, 99), r.getrandbits(62)) for i in range(600)]
    got = {x.o: (x.i, x.a, x.x) for x in C.running(spark.createDataFrame(rows, "i long, o long, a long, x long"), ["o"], sums=("a",), xors=("x",)).collect()}
    rows.sort(key=lambda x: x[1])
    a, x = itertools.accumulate(q[2] for q in rows), itertools.accumulate((q[3] for q in rows), lambda p, q: p ^ q)
    assert got == {q[1]: (q[0], m, n) for q, m, n in zip(rows, a, x, strict=True)}


def test_tables_can_be_dropped(spark):
    from pathlib import Path

    from tessellum.plans import stages

    stages._written.clear()
    got = C.follow(spark.createDataFrame([(1, 2), (2, 3)], "node long, to long")).collect()
    made = [Path(x.removeprefix("file:").replace("//", "/")) for x in stages._written]
    assert len(got) == 2 and made and all(x.exists() for x in made)
    assert stages.drop_tables(spark) == len(made) and not any(x.exists() for x in made) and stages.drop_tables(spark) == 0


def test_blocks_change_nothing(spark, monkeypatch):
    """Rings and chains within a block, over two and over many, loops, and ends without a link."""
    r = random.Random(8)
    names = r.sample(range(2000), 700)
    links, want, at = [], set(), 0
    for n, ring in [(1, True), (2, True), (5, True), (90, True), (2, False), (3, False), (120, False), *((r.randint(2, 30), r.random() < 0.5) for _ in range(25))]:
        own, at = names[at : at + n], at + n
        if r.random() < 0.4:
            own = sorted(own)  # mostly within blocks
        links += list(zip(own, own[1:], strict=False)) + [(own[-1], own[0])] * ring
        start = own.index(min(own)) if ring else 0
        want |= {(x, min(own), ring, (k - start) % n) for k, x in enumerate(own)}
    r.shuffle(links)
    frame = spark.createDataFrame(links, "node long, to long")
    rounds, own_follow = [], C.follow
    monkeypatch.setattr(C, "follow", lambda links, **kw: rounds.append(links.count()) or own_follow(links, **kw))
    for width in (5000, 150, 7):
        got = C.chains(frame, block=F.floor(F.col("node") / width))
        assert {tuple(x) for x in got.select("node", "chain", "ring", "pos").collect()} == want and got.count() == len(want)
    # in one block only chains with an end are left to the rounds, one row each
    assert rounds[0] == sum(1 for x in want if x[3] == 0 and not x[2])
    assert C.chains(frame.limit(0), block=F.lit(0)).count() == 0
