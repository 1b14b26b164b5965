"""Operator 12 against links by comparing all spans, with ids from the libraries themselves."""

import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessellum.llm import alignment, queries
from tessellum.llm.token_counts import byte_alphabet

from .brute import alignment as brute

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["'s", " ", "   ", "\t", "\n", "a", "the", "ing", "É", "é", "漢字", "😀", "́", "\x1c", "\xa0", "1", "2024", "<|endoftext|>", "<s>", "<0x41>", "▁", "-", "...", "\0", "ß", "ि", "Straße", "señor"]


@pytest.fixture(scope="module")
def libraries():
    t, s = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    byte_of = {c: i for i, c in enumerate(byte_alphabet())}
    piece = lambda p: bytes((int(m[1], 16),)) if (m := re.fullmatch("<0x(..)>", p)) else p.replace("▁", " ").encode()
    return (lambda x: t.encode(x, add_special_tokens=False).ids, s.encode, lambda i: bytes(byte_of[c] for c in t.id_to_token(i)), lambda i: piece(s.id_to_piece(i)))


def odd_texts(n):
    rng = random.Random(12)
    return ["", " ", "  ", "b ", " b  ", "▁", "x ▁", "<|endoftext|>", *("".join(rng.choices(ODD, k=rng.randint(1, 14))) for _ in range(n))]


def test_pieces_are_the_models(libraries):
    pieces = alignment.Pieces(B, keep=40)
    for text in odd_texts(3000):
        got, want = pieces.encode([" " + text])[0] if text else None, libraries[1](text)
        if not text or "▁" in text:
            assert got is None
        else:
            assert got.tolist() == want, text
        assert len(pieces.known) <= 40 + len(text) and len(pieces.known.older) <= 100


def test_merge_steps():
    steps, at_a, at_b, closes = alignment.merge(np.array([2, 3, 6]), np.array([3, 4, 5, 6]))
    assert [x.tolist() for x in (steps, at_a, at_b, closes)] == [[2, 3, 4, 5, 6], [0, 1, 2, 2, 2], [0, 0, 1, 2, 3], [False, True, False, False, True]]


def test_query_on_whole_table(spark, libraries):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 30_000]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, alignment.aligned(frame, A, B).collect())) == sorted(brute(rows, *libraries))
    assert queries.op12_alignment(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_odd_texts_over_many_batches(spark, libraries):
    rows = [(k if k % 50 else None, t) for k, t in enumerate([None, *odd_texts(400), *["the same the same"] * 300])]
    frame = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], "doc_id long, text string, pair string, row int").repartition(7)
    got = alignment.aligned(frame, A, B)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, *libraries), key=key)
    assert got.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_pair_counts_and_groups(spark, libraries):
    frame = spark.createDataFrame([(1, "the cat"), (2, "the the cat"), (3, None)], "doc_id long, text string")
    pairs = {(r.a, r.b): r.held for r in alignment.pair_counts(frame, A, B).collect()}
    assert set(pairs.values()) == {2} and len(pairs) >= 2
    groups = {r.doc_id: r.groups for r in alignment.token_groups(frame, A, B).collect()}
    assert groups[3] == "" and groups[1].count(";") == 1 and groups[2].split(";")[0] == groups[2].split(";")[1] == groups[1].split(";")[0]


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned(frame, A, B).count() == 0 and alignment.pair_counts(frame, A, B).count() == 0


def test_a_long_text_beside_short_ones(spark, libraries):
    text = "international straße 漢字 " * 4000
    frame = spark.createDataFrame([(1, text), (2, "straße")], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.aligned(frame, A, B).collect()}
    assert got[1].n_a == len(libraries[0](" " + text)) and got[1].n_b == len(libraries[1](text))
    ends = {x for f, ids in ((libraries[2], libraries[0](" " + text)), (libraries[3], libraries[1](text))) for x in itertools.accumulate(len(f(i)) for i in ids)}
    assert got[1].n_links == len(ends) and got[1].n_links <= got[1].count_sum <= 2 * got[1].n_links
