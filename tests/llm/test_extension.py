"""Seeds only propose; the words decide what is cut."""

import random

import numpy as np

from . import brute


def rows(seed: int = 2, n: int = 120):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcd") for _ in range(r.randint(1, 5))) for _ in range(200)]
    passages = [[r.choice(vocabulary) for _ in range(k)] for k in (50, 60, 90, 140)]
    out = []
    for d in range(n):
        words = []
        for _ in range(r.randint(1, 4)):
            words += [r.choice(vocabulary) for _ in range(r.randint(0, 30))]
            p = r.choice(passages)
            a = r.randint(0, len(p) - 40)
            words += p[a : a + r.randint(40, len(p))]
        out.append((d, " ".join(words)))
    return out


def test_extended():
    from tessellum.llm.substring_dedup import extended

    w = [f"w{i}".encode() for i in range(12)]
    other = w[:4] + [b"zz"] + w[5:]
    assert extended(b" ".join(w), b" ".join(w), 5) == [(0, 12)]
    assert extended(b" ".join(w), b" ".join(other), 5) == [(5, 7)]
    assert extended(b" ".join(w), b" ".join(other), 4) == [(0, 4), (5, 7)]
    assert extended(b"a b", b"ab", 1) == []


def test_false_proposals_cut_nothing(spark, monkeypatch):
    """Partners a word off agree nowhere by design; the words say so, and nothing is cut that does not stand elsewhere."""
    from pyspark.sql import functions as F

    from tessellum.llm import substring_dedup as s

    docs = rows(3, 40)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    whole = s.partners
    monkeypatch.setattr(s, "partners", lambda *a: whole(*a).withColumn("first", F.struct("first.did", "first.th", (F.col("first.start") + 1).alias("start"))).where("first.start > 0"))
    cut = {x.doc_id: x.n_removed for x in s.kept_words(frame).collect()}
    want = {x[0]: x[2] for x in brute.substring_dedup(dict(docs))}
    assert all(cut[d] <= want[d] for d in want) and sum(want.values()) > 0


def test_against_brute_force(spark):
    from tessellum.llm.substring_dedup import kept_words

    for seed in (4, 5):
        docs = rows(seed)
        got = kept_words(spark.createDataFrame(docs, "doc_id long, text string"), digest=True).collect()
        assert sorted(map(tuple, got)) == sorted(brute.substring_dedup(dict(docs)))


def test_long_texts_in_chunks(spark, monkeypatch):
    """Texts over the chunk size, which hold each window once."""
    from tessellum.llm import winnow

    values, first = np.arange(5000, dtype=np.uint64) % np.uint64(700), np.array([0, 4800, 4800, 5000])
    whole = winnow.runs(values, first, 50, 10)
    monkeypatch.setattr(winnow, "CHUNK", 600)
    parts = winnow.runs(values, first, 50, 10)
    listed = lambda r: sorted((int(a), int(b) + k, int(c)) for a, b, n, c in zip(r["row"], r["start"], r["n"], r["anchor"], strict=True) for k in range(n))
    assert listed(parts) == listed(whole)


def test_many_equal_rows(spark):
    """Ten thousand rows without an id and with one text: each loses what stands in document 1, and nothing grows with their number but the rows."""
    from tessellum.llm.substring_dedup import kept_words

    text = " ".join(f"w{i}" for i in range(120))
    frame = spark.range(10_000).selectExpr("CAST(NULL AS LONG) AS doc_id", f"'{text}' AS text").unionByName(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    got = kept_words(frame).groupBy("doc_id", "n_removed").count().collect()
    assert sorted((x.doc_id or 0, x.n_removed, x["count"]) for x in got) == [(0, 120, 10_000), (1, 0, 1)]


def test_many_equal_rows_of_bytes(spark):
    from tessellum.llm.run_index import kept_bytes

    text = " ".join(f"w{i}" for i in range(120))
    frame = spark.range(10_000).selectExpr("CAST(NULL AS LONG) AS doc_id", f"'{text}' AS text").unionByName(spark.createDataFrame([(1, "other " + text)], "doc_id long, text string"))
    got = kept_bytes(frame).groupBy("doc_id", "n_removed").count().collect()
    assert sorted((x.doc_id or 0, x.n_removed, x["count"]) for x in got) == [(0, len(text), 10_000), (1, len(text), 1)]


def test_groups_of_any_size_give_the_same(spark):
    """However few kinds a block may hold, splitting loses no match and adds none."""
    from tessellum.llm.run_index import kept_bytes

    r = random.Random(11)
    core = "".join(r.choice("abcdefgh") for _ in range(260))
    docs = [(d, "".join(r.choice("xyz") for _ in range(r.randint(0, 40))) + core[r.randint(0, 60) : 260 - r.randint(0, 60)] + "".join(r.choice("xyz") for _ in range(r.randint(0, 40)))) for d in range(60)]
    frame, want = spark.createDataFrame(docs, "doc_id long, text string"), sorted(brute.byte_dedup(docs))
    for crowd in (1, 3, 1000):
        assert sorted(map(tuple, kept_bytes(frame, crowd=crowd, digest=True).collect())) == want
