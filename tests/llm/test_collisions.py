"""Strings on which polynomial hashes modulo a power of two collide whatever the base: Thue-Morse words and their complements."""

import pytest

from . import brute


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_lines_and_words_are_told_apart(spark, size):
    from tessellum.llm.quality_rules import judged

    x, y = thue_morse(size, "a", "b"), thue_morse(size, "b", "a")
    rows = [(1, f"{x}\n{y}"), (2, f"{x}\n{y}\n{x}"), (3, f"{x} a b c d {y} a b c d"), (4, f"{x} a b c d {x} a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judged(docs, labels).collect()}
    assert got == {d: brute.rules(t) for d, t in rows}
    assert [got[d][3] for d in (1, 2)] == [0, 1]


@pytest.mark.parametrize("size", [1024, 4096])
def test_windows_with_such_words(spark, size):
    from tessellum.llm.substring_dedup import kept_words

    x, y = thue_morse(size, "a", "b"), thue_morse(size, "b", "a")
    frame = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"{frame} {x} {frame}"), (2, f"{frame} {y} {frame}"), (3, f"{frame} {x} {frame}"), (4, " ".join(thue_morse(256, "p", "q"))), (5, " ".join(thue_morse(256, "q", "p")))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, kept_words(docs, digest=True).collect())) == sorted(brute.substring_dedup(dict(rows)))


def test_bytes(spark):
    from tessellum.llm.run_index import kept_bytes

    x, y = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    rows = [(1, x[:256]), (2, y[:256]), (3, "c" + x), (4, y + "d"), (5, x[:199]), (6, "e" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, kept_bytes(docs, digest=True).collect())) == sorted(brute.byte_dedup(rows))
