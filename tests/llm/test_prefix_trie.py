"""Operator 11 against the tokenizers library, and what the trie shares."""

import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessellum.llm import prefix_trie, queries

from .brute import sha

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["'", "s", "ll", "re", " ", "  ", "\t", "\n", "a", "the", "ing", "É", "é", "漢", "字", "😀", "́", "\x1c", "\x85", "\xa0", "1", "22", "²", "<|endoftext|>", "<|", "|>", "-", "--", "...", "﻿", "\0", "ß", "Σ", "ि"]


@pytest.fixture(scope="module")
def v():
    return prefix_trie.Vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    return {True: Tokenizer.from_file(PATH), False: plain}


@pytest.mark.parametrize("specials", [True, False])
def test_odd_texts(v, library, specials):
    rng = random.Random(11)
    texts = ["", *("".join(rng.choices(ODD, k=rng.randint(0, 30))) for _ in range(1500))]
    for text, ids in zip(texts, v.encode(texts, specials), strict=True):
        want = library[specials].encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert v.decode(ids.tolist()) == library[specials].decode(want, skip_special_tokens=False) == text


def test_decodes_any_ids(v, library):
    rng = random.Random(3)
    for _ in range(500):
        ids = rng.choices(range(50257), k=7)
        assert v.decode(ids) == library[True].decode(ids, skip_special_tokens=False)


def test_long_words_take_a_step_a_byte(v, library):
    began = time.process_time()
    texts = ["'" * 200_000, "a" * 200_000, "ab" * 100_000, "-'" * 100_000]
    got = v.encode(texts)
    assert time.process_time() - began < 5
    for text, ids in zip(texts, got, strict=True):
        assert v.decode(ids) == text
    assert v.encode(["a" * 3000])[0].tolist() == library[True].encode("a" * 3000).ids


def test_trie_shares_prefixes():
    root = prefix_trie.trie(["inter", "internal", "international", "in", "out", "interne"])
    (inn, out) = (root.below[ord("i")], root.below[ord("o")])
    assert (inn.label, inn.word, out.label) == (b"in", "in", b"out")
    assert inn.below[ord("t")].label == b"ter"
    nodes, todo = 0, [root]
    while todo:
        node = todo.pop()
        nodes += len(node.label)
        todo += node.below.values()
    assert nodes == len("international" + "l" + "e" + "out")


def test_tables_stay_bounded():
    v = prefix_trie.Vocabulary(PATH, keep=50)
    words = [f" word{k}" for k in range(400)]
    one = ["".join(words[k : k + 30]) for k in range(0, 390, 7)]
    want = prefix_trie.Vocabulary(PATH).encode(one)
    for text, ids in zip(one, want, strict=True):
        assert v.encode([text])[0].tolist() == ids.tolist()
        assert len(v.known) <= 80 and len(v.known.older) <= 80
    v.release()
    assert not v.known and not v.known.older and v.encode(one[:1])[0].tolist() == want[0].tolist()


def test_query_on_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op11_prefix_trie(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library[True].encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(library[True].decode(ids, skip_special_tokens=False).encode()))


def test_odd_tables(spark):
    schema = "doc_id long, text string, n_tokens string, ids_sha256 int"
    docs = spark.createDataFrame([(1, None, "x", 1), (2, "", None, 2), (None, "a b", "y", 3), (2, "a b", "y", 3), (2, "a b", "y", 3)], schema)
    got = sorted(map(tuple, prefix_trie.encode_digests(docs, PATH).collect()), key=repr)
    e = sha(b"")
    assert got[:2] == [(1, 0, e, e), (2, 0, e, e)] and [r[:2] for r in got[2:]] == [(2, 2), (2, 2), (None, 2)]
    assert prefix_trie.encode_digests(docs.limit(0), PATH).count() == 0
    assert {tuple(r.ids) for r in prefix_trie.encode_texts(docs, PATH).collect()} == {(), (64, 275)}
