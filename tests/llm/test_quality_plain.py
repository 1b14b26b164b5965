"""The quality queries on a table, recounted with plain Python."""

import math
import re
from collections import Counter

import numpy as np

from . import brute

SF = "/root/testdata/sf0.001"


def tables(spark):
    return (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))


def test_rules_on_table(spark):
    """Every column of the rules' query, the ratio and the verdict included."""
    from tessellum.llm.queries import op7_quality_rules
    from tessellum.llm.quality_rules import BITS, THRESHOLD, UNIT

    docs, labels = tables(spark)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1}
    bucket = lambda g: (int.from_bytes(g, "big") * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - BITS)
    grams = {d: Counter(bucket(t[i : i + 4]) for i in range(len(t) - 3)) for d, t in texts.items()}
    raw, good = Counter(), Counter()
    for d, g in grams.items():
        raw.update(g)
        if d in trusted:
            good.update(g)
    of = lambda c, b: math.log((c[b] + 1) / (sum(c.values()) + (1 << BITS)))
    totals = sum(raw.values()) + (1 << BITS), sum(good.values()) + (1 << BITS)
    table = {b: round((math.log((good[b] + 1) / totals[1]) - math.log((raw[b] + 1) / totals[0])) * UNIT) for b in raw}
    assert abs(of(raw, next(iter(raw))) - math.log((raw[next(iter(raw))] + 1) / totals[0])) < 1e-12
    rows = op7_quality_rules(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        n = sum(grams[r.doc_id].values())
        total = sum(table[b] * k for b, k in grams[r.doc_id].items())
        want = brute.rules(texts[r.doc_id].decode())
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert abs(r.log_ratio - total / max(1, n) / UNIT) < 1e-9
        assert r.kept == (not want[5] and total >= math.floor(THRESHOLD * UNIT) * n)


def shape(text: str) -> list[float]:
    """The features of ``text_stats`` by their definitions."""
    words = brute.WORD.findall(text)
    n_words, chars, symbols, dup, repeat, _ = brute.rules(text)
    lines = sum(1 for x in text.split("\n") if brute.WORD.search(x))
    n, size = max(1, n_words), max(1, len(text.encode()))
    return [
        min(symbols / n, 2),
        min(symbols / n, 0.1) * 10,
        repeat / n,
        dup / max(1, lines),
        math.log1p(n_words),
        n_words < 10,
        len(set(words)) / n,
        min(chars / n, 30) / 10,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(re.findall("[0-9]", text)) / size,
        len(re.findall("[A-Z]", text)) / n,
        sum(w[-1] in ".,;:!?" for w in words) / n,
        sum(b >= 0xC0 for b in text.encode()) / size,
    ]


def test_ranking_on_table(spark):
    """Scores from the definition of the features, and the cut from the labels' shares."""
    from tessellum.llm.quality_rank import fit
    from tessellum.llm.queries import op3_quality_rank

    docs, labels = tables(spark)
    model = fit(docs, labels, folds=5, fold=0, threshold=0.3)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r.score for r in op3_quality_rank(spark, SF).collect()}
    for d, t in texts.items():
        s = float(np.dot(shape(t), model["w"])) - model["cut"]
        assert abs(got[d] - 1 / (1 + math.exp(-max(-40, min(40, model["slope"] * s + model["at"]))))) < 1e-6
    assert set(got) == set(texts)


def test_cut_by_shares_of_all_labels():
    """A sample of equal halves is cut where nine tenths are good if nine tenths of all labels are."""
    from tessellum.llm.quality_rank import weighted_cut

    s, y = np.arange(200.0), (np.arange(200) >= 100).astype(int)
    assert weighted_cut(s, y, {0: 100, 1: 900}) == 99.5
    mixed = np.tile([0, 1], 100)
    assert weighted_cut(s, mixed, {0: 100, 1: 900}) < 40 < weighted_cut(s, mixed, {0: 500, 1: 500}) < 120


def test_odd_texts(spark):
    """Empty, white, very long and repeated texts, and an empty table."""
    from tessellum.llm import quality_rank, quality_rules

    rows = [(1, "good words stand here in a row and go on for long enough to be text"), (2, "# # # #"), (3, None), (3, ""), (4, " \n\t\x0b"), (5, "w " * 200_000), (6, "x" * 500_000), (2, "# # # #"), (None, "\n" * 100_000)]
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, words string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.judged(docs, labels).drop("kept", "log_ratio").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((d, *brute.rules(t))) for d, t in rows)
    scores = quality_rank.scored(docs, labels).collect()
    assert len(scores) == len(rows) and all(0 <= r.score <= 1 for r in scores)
    assert quality_rules.judged(docs.limit(0), labels).count() == quality_rank.scored(docs.limit(0), labels).count() == 0
