"""Operator 13 against its definition on small tables; the query itself is compared with SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessellum.llm import importance


def brute(rows, target, length, buckets, least, percent):
    def grams(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, length + 1) for i in range(len(w) - n + 1)]

    held, s, t = [(d, *grams(x)) for d, x in rows], Counter(), Counter()
    for _, _, g in held:
        s.update(g)
    for x in target:
        t.update(grams(x)[1])
    whole_s, whole_t = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (whole_s + buckets) / ((s[k] + 1) * (whole_t + buckets))))
    out = []
    for d, n, g in held:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, g))
        out.append([d, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    can = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(can[: percent * len(can) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("length", [1, 2, 3])
def test_against_definition(spark, length):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(None, None), (900_001, ""), (900_002, "É ß 漢字 a-b A_B 7é " * 9), (900_003, "one two"), (900_004, "\0x\x7fy " * 30)]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [None, ""]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, weight string, rank int").repartition(5)
    asked = spark.createDataFrame([(t,) for t in target], "text string").withColumn("item_id", F.lit(1))
    got = importance.resampled(docs, asked, target_id="item_id", length=length, buckets=500, least=12, percent=30)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, target, length, 500, 12, 30)
    assert importance.drawn(docs, asked, target_id="item_id", length=length, buckets=500, least=12, percent=30).count() == got.where("rank > 0").count()


def test_each_tuple_is_hashed_once():
    d = importance.Dictionary(2, 100)
    n, row, bucket, times = d.counts(["b a b a", "", "a B"])
    assert n.tolist() == [4, 0, 2] and len(d.met) == 4 and sorted(d.words) == [b"a", b"b"]
    want = Counter((0, zlib.crc32(x) % 100) for x in (b"b", b"a", b"b", b"a", b"b a", b"a b", b"b a")) + Counter((2, zlib.crc32(x) % 100) for x in (b"a", b"b", b"a b"))
    assert dict(zip(zip(row.tolist(), bucket.tolist(), strict=True), times.tolist(), strict=True)) == want


def test_tables_stay_bounded():
    small, large = importance.Dictionary(2, 1000, keep=20), importance.Dictionary(2, 1000)
    for k in range(50):
        texts = [f"w{k} w{k + 1} w{k + 2} x", f"w{k} y w{k}"]
        for a, b in zip(small.counts(texts), large.counts(texts), strict=True):
            assert a.tolist() == b.tolist()
        assert len(small.met) <= 20 and len(small.words) <= 30


def test_ranks_of_many_equal_rows(spark):
    rows = spark.createDataFrame([(5, 7)] * 300 + [(9, k) for k in range(200)] + [(1, None)] * 3, "score long, doc_id long")
    got = importance.ranked(rows, [F.desc("score"), F.asc_nulls_last("doc_id")]).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 504))
    assert all(r["rank"] == r.doc_id + 1 for r in got if r.score == 9) and {r["rank"] for r in got if r.score == 1} == {501, 502, 503}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert importance.resampled(none, one).count() == 0
    got = importance.resampled(one, none, least=1, percent=100).first()
    assert (got.n_features, got["rank"]) == (3, 1) and got.weight == 3 * math.floor(1000 * math.log(10003 / (2 * 10000)))
