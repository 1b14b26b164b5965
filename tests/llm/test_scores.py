import random
from zlib import crc32

import numpy as np
import pytest

from . import brute

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "y") for d, t in rows], "doc_id long, text string, score int, y string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def odd_texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    r = random.Random(seed)
    bits = ["a", "bb", "é", "日本", " ", "  ", "\n", "\n\n", "\t", "&", "|x", "same line\n", "one two three four five ", "\r\n", "\x0b", "#"]
    rows: list = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 60)))) for i in range(150)]
    return [*rows, (None, "x y"), (500, None), (501, ""), (502, "\n" * 50), (503, "w " * 4000), (503, "w " * 4000), (504, "z" * 70_000 + " " + "z" * 70_000)]


def test_base_rules(spark):
    from tessellum.llm.quality_rules import judged

    rows = odd_texts()
    got = judged(frame(spark, rows), labels(spark, [(1, 1, 0)])).drop("kept", "log_ratio").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((d, *brute.rules(t))) for d, t in rows)


def test_rules_keep_good_and_drop_bad(spark):
    from tessellum.llm.queries import op7_quality_rules

    got = {x.doc_id: x for x in op7_quality_rules(spark, SF2).collect()}
    marks = {x.doc_id: x.quality for x in spark.read.parquet(f"{SF2}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF2}/documents.parquet").count()
    good = [got[d].kept for d, q in marks.items() if q and not got[d].base_failed]
    bad = [got[d].kept for d, q in marks.items() if not q]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_log_ratio_by_hand(spark):
    """The table and the means, recounted with dictionaries."""
    from tessellum.llm.quality_rules import BITS, UNIT, judged

    rows = [(1, "abcabc abc"), (2, "xyz|xyz|xyz"), (3, "abc"), (4, None)]
    key = lambda b: (int.from_bytes(b, "big") * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - BITS)
    grams = {d: [key((t or "").encode()[i : i + 4]) for i in range(len((t or "").encode()) - 3)] for d, t in rows}
    count = lambda b, ids: sum(grams[d].count(b) for d in ids)
    total = lambda ids: sum(len(grams[d]) for d in ids) + (1 << BITS)
    lr = lambda b: round((np.log((count(b, [1]) + 1) / total([1])) - np.log((count(b, grams) + 1) / total(grams))) * UNIT)
    got = {x.doc_id: x.log_ratio for x in judged(frame(spark, rows), labels(spark, [(1, 1, 0), (2, 0, 0)])).collect()}
    for d, g in grams.items():
        assert got[d] == pytest.approx(sum(map(lr, g)) / max(1, len(g)) / UNIT)


def test_quality_held_out(spark):
    from tessellum.llm.queries import op3_quality_rank

    got = {x.doc_id: x for x in op3_quality_rank(spark, SF2).collect()}
    assert all(x.held_out == (crc32(str(d).encode()) % 5 == 0) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for d, x in got.items())
    marks = [(got[x.doc_id], x.quality) for x in spark.read.parquet(f"{SF2}/labels.parquet").collect()]
    held = [(g.predicted == q) for g, q in marks if g.held_out]
    assert np.mean(held) > 0.95


def test_toxicity_held_out(spark):
    from tessellum.llm.queries import op4_toxicity

    got = {x.doc_id: x for x in op4_toxicity(spark, SF2).collect()}
    assert all(x.held_out == (crc32(str(d).encode()) % 3 == 1) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for d, x in got.items())
    marks = [(got[x.doc_id], x.toxic) for x in spark.read.parquet(f"{SF2}/labels.parquet").collect()]
    assert np.mean([g.predicted == t for g, t in marks if g.held_out]) > 0.93
    assert np.mean([g.predicted for g, t in marks if not t]) < 0.03


def test_no_labels_and_empty(spark):
    from tessellum.llm import quality_rank, quality_rules, toxicity

    none, one = labels(spark, []), frame(spark, [(None, None), (1, "")])
    assert {x.score for x in quality_rank.scored(one, none).collect()} == {0.5}
    assert {(x.score, x.held_out) for x in toxicity.scored(one, none).where("doc_id IS NULL").collect()} == {(0.0, False)}
    assert {x.kept for x in quality_rules.judged(one, none).collect()} == {False}
    for f in (quality_rank.scored, toxicity.scored, quality_rules.judged):
        assert f(frame(spark, []), none).count() == 0


def test_automaton_is_edit_distance():
    from tessellum.llm.toxicity import Lexicon, budget

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(3)
    terms = ["abcab", "bacbac", "cabbage", "aabbccaabb", "abc"]
    lexicon = Lexicon(terms, [])
    for _ in range(3000):
        w = list(r.choice(terms)) if r.random() < 0.7 else [r.choice("abc") for _ in range(r.randint(1, 10))]
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(w) + 1)
            w[at : at + r.randint(0, 1)] = r.choice(["", "a", "b", "c", "g"])
        w = "".join(w)
        want = min((distance(w, t) for t in terms if distance(w, t) <= budget(t)), default=None)
        got = lexicon.match(w)
        assert (got[0] if got else None) == want, w


def test_context_separates_quotation():
    from tessellum.llm.toxicity import Lexicon, features

    lexicon = Lexicon(["idiot", "worthless"], ["vequ"])
    assert features(lexicon, "you idiot, go")[1] == 1
    assert features(lexicon, 'he used "idiot" here')[1:4] == [0, 0, 1]
    assert features(lexicon, "they said idiot here")[3] == 1
    assert features(lexicon, "wortless things")[5] == 1
    assert features(lexicon, "vequais")[1] == 1
    assert features(lexicon, "") == [1.0] + [0.0] * 8


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessellum.llm.queries import op1_token_counts
    from tessellum.llm.token_counts import PrefixCounter, token_counts, within_budget

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [*odd_texts(), (600, "<|endoftext|> a<|startoftext|>"), (601, "It's ΣΑΣ İx don't 12½"), (602, "q" * 3000)]
    want = sorted(((-1 if d is None else d), len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in rows)
    got = token_counts(frame(spark, rows), path, 100).collect()
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_bytes, x.n_tokens) for x in got) == want
    assert all(x.over_limit == (x.n_tokens > 100) for x in got)
    whole = {x.doc_id: x.text for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(x.n_tokens == len(t.encode(whole[x.doc_id], add_special_tokens=False).ids) for x in op1_token_counts(spark, SF).collect())
    c = PrefixCounter(path)
    for x in ("It's don't 'round we'll", "Überstraße 12", "日本 a!!'s", "fooled"):
        n = c.normal(x)
        assert c.prefix_counts(x) == [c.count(n[:i]) for i in range(len(n) + 1)]
        fit = c.fits(x, 3)
        assert max(c.prefix_counts(x)[: fit + 1]) <= 3 and (fit == len(n) or c.prefix_counts(x)[fit + 1] > 3)
    assert within_budget(frame(spark, [(1, None)]), path, 5).first().n_chars_fit == 0


def test_byte_bpe(spark):
    import base64

    import public_tokenizers as public
    import tiktoken

    from tessellum.llm.byte_bpe import ByteBpe, Utf8Stream, encode_digests, encode_texts
    from tessellum.llm.queries import op2_byte_bpe

    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = odd_texts()
    got = encode_digests(frame(spark, rows), path, public.PATTERN).collect()
    want = [(d, e.encode_ordinary(x or ""), x or "") for d, x in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((d, len(i), brute.sha(",".join(map(str, i)).encode()), brute.sha(x.encode()))) for d, i, x in want)
    listed = encode_texts(frame(spark, rows), path, public.PATTERN).collect()
    assert sorted(map(repr, map(tuple, listed))) == sorted(repr(x) for x in want)
    whole = {x.doc_id: x.text for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(x.n_tokens == len(e.encode_ordinary(whole[x.doc_id])) for x in op2_byte_bpe(spark, SF).collect())
    assert ByteBpe(path, public.PATTERN).decode([ranks[b"\xe6"], ranks[b"a"]], 1) == "�a"
    for text in ("aé日🙂", "🙂" * 5):
        for k in (1, 2, 3):
            s, raw = Utf8Stream(), text.encode()
            assert "".join([*(s.feed(raw[i : i + k]) for i in range(0, len(raw), k)), s.end()]) == text
