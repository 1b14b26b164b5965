"""Rows without an id are told apart by a hash of their text; these two texts share Spark's 32-bit one."""

import pytest

PASSAGE = " ".join(f"word{i}" for i in range(60))
LONG, SHORT = f"7683 token=abcdef123456 {PASSAGE}", "plain 27802"


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(None, LONG), (None, SHORT), (1, PASSAGE)], "doc_id long, text string")
    assert df.where("doc_id IS NULL").select(F.hash("text")).distinct().count() == 1
    return df


def test_secrets_keep_to_their_row(docs):
    from tessellum.llm.secrets import redacted, scanned

    got = scanned(docs).where("doc_id IS NULL").select("n_assign", "spans").collect()
    assert sorted(map(tuple, got)) == [(0, ""), (1, "assign:5:23")]
    assert {x.text for x in redacted(docs).collect()} == {f"7683 [assign] {PASSAGE}", SHORT, PASSAGE}


def test_word_cuts_keep_to_their_row(docs):
    from tessellum.llm.substring_dedup import kept_words

    got = kept_words(docs).where("doc_id IS NULL").select("n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got)) == [(2, 0, SHORT), (62, 60, "7683 token=abcdef123456")]


def test_byte_cuts_keep_to_their_row(docs):
    from tessellum.llm.run_index import kept_bytes

    got = kept_bytes(docs).where("doc_id IS NULL").select("n_bytes", "n_removed").collect()
    assert sorted(map(tuple, got)) == [(len(SHORT), 0), (len(LONG), len(PASSAGE))]
