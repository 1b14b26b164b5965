import random

import numpy as np
import pytest

from . import brute

SF = "/root/testdata/sf0.001"


def made_docs(seed: int = 3, n: int = 120) -> list[tuple[int, str | None]]:
    """Documents with shared passages, near and exact copies, runs of one letter, and odd texts."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    passages = [text(k) for k in (49, 50, 55, 70, 120)]
    out: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \n\t"), (3, "x" * 700), (4, "x" * 300 + "y" + "x" * 250), (5, "word " * 150), (6, "日本 " * 120)]
    while len(out) < n:
        k = len(out)
        kind = r.random()
        if kind < 0.15 and k > 20:
            t = out[r.randint(7, k - 1)][1] or ""
        elif kind < 0.35 and k > 20:
            w = (out[r.randint(7, k - 1)][1] or "a").split()
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice(words)
            t = " ".join(w)
        else:
            t = text(r.randint(0, 90)) + r.choice([" ", "\n", "  "]) + r.choice(passages) + " " + text(r.randint(0, 60)) + (" " + r.choice(passages) if r.random() < 0.3 else "")
        out.append((k, t))
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs():
    return made_docs()


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, anchor int")


def test_substring_dedup(spark, docs):
    from tessellum.llm.substring_dedup import kept_words

    got = kept_words(frame(spark, docs), digest=True).collect()
    assert sorted(map(tuple, got)) == sorted(brute.substring_dedup(dict(docs)))


def test_substring_dedup_on_table(spark):
    from tessellum.llm.queries import op6_substring_dedup

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, op6_substring_dedup(spark, SF).collect())) == sorted(brute.substring_dedup(dict(map(tuple, rows))))


@pytest.mark.parametrize("crowd", [256, 2])
def test_byte_dedup(spark, docs, crowd):
    from tessellum.llm.run_index import kept_bytes

    got = kept_bytes(frame(spark, docs), crowd=crowd, digest=True).collect()
    assert sorted(map(tuple, got)) == sorted(brute.byte_dedup(docs))


def test_byte_dedup_on_table(spark):
    from tessellum.llm.queries import op10_run_index

    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op10_run_index(spark, SF).collect())) == sorted(brute.byte_dedup(rows))


def test_equal_rows_and_null_ids(spark):
    from tessellum.llm.run_index import kept_bytes
    from tessellum.llm.simhash import grouped
    from tessellum.llm.substring_dedup import kept_words

    t = " ".join(f"w{i}" for i in range(80))
    df = frame(spark, [(7, t), (7, t), (None, t), (None, None)])
    assert sorted((x.doc_id or -1, x.n_removed) for x in kept_words(df).collect()) == [(-1, 0), (-1, 80), (7, 0), (7, 0)]
    assert sorted((x.doc_id or -1, x.n_removed) for x in kept_bytes(df).collect()) == [(-1, 0), (-1, len(t)), (7, len(t)), (7, len(t))]
    assert sorted((x.doc_id or -1, x.component_id or -1) for x in grouped(df).collect()) == [(-1, -1), (-1, 7), (7, 7), (7, 7)]


def test_empty_table(spark):
    from tessellum.llm.run_index import kept_bytes
    from tessellum.llm.simhash import grouped
    from tessellum.llm.substring_dedup import kept_words

    df = frame(spark, [])
    assert kept_words(df).count() == kept_bytes(df).count() == grouped(df).count() == 0


def test_run_index_marks():
    from tessellum.llm.run_index import RunIndex

    r = random.Random(5)
    for _ in range(30):
        base = bytes(r.choice(b"ab") for _ in range(60))
        segments = [bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 20))) + base[r.randint(0, 30) : r.randint(30, 60)] for _ in range(8)]
        index = RunIndex([np.frombuffer(s, np.uint8) for s in segments])
        marked = [bytearray(len(s)) for s in segments]
        for seg, start, size in zip(*index.marked(12), strict=True):
            marked[seg][start : start + size] = b"\1" * size
        count: dict[bytes, int] = {}
        for s in segments:
            for i in range(len(s) - 11):
                count[s[i : i + 12]] = count.get(s[i : i + 12], 0) + 1
        for s, m in zip(segments, marked, strict=True):
            want = bytearray(len(s))
            for i in range(len(s) - 11):
                if count[s[i : i + 12]] > 1:
                    want[i : i + 12] = b"\1" * 12
            assert m == want
        assert int(index.lengths.sum()) == len(index.text)


def test_simhash(spark, docs):
    from tessellum.llm.queries import op9_simhash
    from tessellum.llm.simhash import grouped

    got = {(x.doc_id, f"{x.fp & (1 << 64) - 1:016x}", x.component_id) for x in grouped(frame(spark, docs)).collect()}
    assert got == brute.simhash(docs)
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(x) for x in op9_simhash(spark, SF).collect()} == brute.simhash(rows)


def test_anchors_meet():
    """Any two fingerprints with up to four differing bits meet where one of them lives."""
    from tessellum.llm.simhash import anchors_of

    r = random.Random(1)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, 4)):
            b ^= 1 << bit
        _, home = anchors_of(np.array([b], np.uint64), True)
        _, sent = anchors_of(np.array([a], np.uint64), False)
        assert set(home.tolist()) & set(sent.tolist())
