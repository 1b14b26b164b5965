"""Related items against a plain count, in one block and in many, and what of them is moved."""

import itertools
import random

import pytest

from tessellum.operators import documents
from tessellum.plans import registry


def plain(sold, tags, weight, tag_weight, limit):
    has, broad = {}, {}
    for x, t in sold:
        if x is not None and t is not None:
            has.setdefault(x, set()).add(t)
    for t, k in tags:
        if k is not None:
            broad.setdefault(t, set()).add(k)
    tagged = {x: set().union(*(broad.get(t, ()) for t in own)) for x, own in has.items()}
    want = set()
    for x, own in has.items():
        score = {y: weight * len(own & has[y]) + tag_weight * len(tagged[x] & tagged[y]) for y in has if y != x}
        best = sorted((-s, y) for y, s in score.items() if s)[:limit]
        want |= {(x, y, -s, k + 1) for k, (s, y) in enumerate(best)}
    return want


@pytest.mark.parametrize(("own", "held", "common"), [(5000, 4_000_000, 200), (7, 40, 5), (7, 40, 0), (7, 40, 1000)])
@pytest.mark.parametrize("named", [False, True])
def test_related(spark, monkeypatch, own, held, common, named):
    monkeypatch.setattr(documents, "OWN", own)
    monkeypatch.setattr(documents, "HELD", held)
    r = random.Random(own + common)
    base = [(x, r.randrange(30)) for x in range(20) for _ in range(r.randrange(1, 9))]
    # copies that share tags only, copies that share all, repeats, unknown keys, items alone
    sold = base + [(x + 20, t + 30) for x, t in base] + [(x + 40, t) for x, t in base[:40]] + base[:5] + [(None, 3), (5, None), (90, 999), (-4, 2), (-4, -7)]
    tags = [(t, f"k{t % 30 // 2}" if t % 7 else None) for t in range(60)] + [(4, "more"), (34, "more"), (-7, "more")]
    kind = "string" if named else "long"
    key = (lambda v: None if v is None else f"{v + 10:04d}") if named else lambda v: v
    sold, tags = [(key(x), key(t)) for x, t in sold], [(key(t), k) for t, k in tags]
    got = documents.related(spark.createDataFrame(sold, f"item {kind}, t {kind}"), item="item", token="t", weight=2, limit=3, tags=spark.createDataFrame(tags, f"t {kind}, tag string"), common=common)
    assert sorted(map(tuple, got.collect())) == sorted(plain(sold, tags, 2, 1, 3))


def test_a_part_of_unknown_brand_has_no_kind(spark, tmp_path):
    spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4)], "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, None, "A", 5), (2, None, "A", 5), (3, "B", "A", 5), (4, "B", "A", 5)], "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = registry.queries()["related_items"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(3, 4, 1, 1), (4, 3, 1, 1)]


def test_tokens_travel_as_lists(spark, monkeypatch):
    kept, own = {}, documents.stash

    def seen(df, name):
        got = own(df, name)
        kept[name] = kept.get(name, 0) + got.count()
        return got

    monkeypatch.setattr(documents, "stash", seen)
    sold = spark.createDataFrame(list(itertools.product(range(300), range(50))), "item long, t long")
    assert documents.related(sold, item="item", token="t", weight=2, limit=4).where("score = 100").count() == 1200
    # one row a token and block or an item, never one an item and token (15,000)
    assert sum(kept.values()) < 3000
