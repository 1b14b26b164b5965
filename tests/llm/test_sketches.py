"""The sketches decide which documents are looked at, and containment only confirms."""

import random

from . import brute


def made(seed: int = 8):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(3, 60)))) for i in range(25)] + [(None, "a b c d e f g")]
    docs = []
    for d in range(200):
        w = [r.choice(words) for _ in range(r.randint(0, 80))]
        inner = (items[r.randrange(len(items))][1]).split()
        for _ in range(r.randint(0, 2)):
            inner[r.randrange(len(inner))] = "zz"
        w[len(w) // 2 : len(w) // 2] = inner[: r.randint(0, len(inner))] if r.random() < 0.4 else inner
        docs.append((d if d else None, " ".join(w)))
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_candidates_hold_every_pair(spark):
    from tessellum.llm.decontaminate import candidates, pairs, sketched
    from tessellum.llm.substring_dedup import id_of, keyed

    docs, items = made()
    df, asked_df = frames(spark, docs, items)
    for threshold in (0.5, 0.8, 1.0):
        asked = sketched(asked_df, threshold, 5)
        assert asked.where("sketch").count() < asked.count()
        met = {tuple(x) for x in candidates(keyed(df), asked).select(id_of(), "item_id").collect()}
        want = brute.contained(docs, items, threshold)
        assert {tuple(x) for x in pairs(df, asked_df, threshold).collect()} == want and want
        assert {x[:2] for x in want} <= met
        assert len(met) < len(docs) * len(items)


def test_no_sketch_no_pair(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tessellum.llm import decontaminate

    df, asked = frames(spark, *made())
    whole = decontaminate.sketched
    monkeypatch.setattr(decontaminate, "sketched", lambda *a: whole(*a).withColumn("sketch", F.lit(False)))
    assert decontaminate.pairs(df, asked).count() == 0


def test_long_text_and_repeated_rows(spark):
    from tessellum.llm.decontaminate import pairs, without_items

    item = " ".join(f"i{k}" for k in range(40))
    long_ = " ".join(f"x{k}" for k in range(150_000))
    docs = [(1, f"{long_} {item}"), (2, long_), (3, item), (3, item), (4, " \n\t "), (None, item.upper())]
    df, asked = frames(spark, docs, [(7, item), (7, item), (8, " ")])
    assert sorted(pairs(df, asked).collect(), key=str) == sorted([(1, 7, 36, 36, 1.0), (3, 7, 36, 36, 1.0), (None, 7, 36, 36, 1.0)], key=str)
    assert sorted(x.doc_id for x in without_items(df, asked).collect()) == [2, 4]
