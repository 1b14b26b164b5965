"""op3 learns from all labelled texts, beyond every number that its tables are bounded by."""

import numpy as np

from .test_scores import frame, labels


def test_every_label_counts(spark):
    """5,000 rejected texts, of which the former sample took 4,000: each is in a pair, and the cut is that of all."""
    from tessellum.llm import quality_rank as q

    rows = [(i, "# " * (1 + i % 37) + "word " * (20 + i % 11)) for i in range(5000)] + [(i, f"words of text {i}, " * (3 + i % 13)) for i in range(5000, 5700)]
    marks = labels(spark, [(i, int(i >= 5000), 0) for i, _ in rows])
    x = q.features(frame(spark, rows))
    kept, counts = q.numbered(x.join(q.marked(marks, "quality", 5, 5), "doc_id"))
    assert counts == {0: 5000, 1: 700}
    assert sorted((r.y, r.i) for r in kept.collect()) == [(0, i) for i in range(5000)] + [(1, i) for i in range(700)]
    one = spark.createDataFrame([(y, i, [float(y * 10_000 + i)] * q.N_FEATURES) for y, n in counts.items() for i in range(n)], "y int, i long, x array<double>")
    got = [r.d[0] for r in q.pairs(one, counts, most_pairs=1).collect()]
    assert sorted(got) == sorted(float(10_000 + i % 700 - i) for i in range(5000))
    every = {0: 3, 1: 4}
    few = one.where("i < 3 OR (y = 1 AND i = 3)")
    assert len({r.d[0] for r in q.pairs(few, every).collect()}) == len({10_000 + b - a for a in range(3) for b in range(4)}) and q.pairs(few, every).count() == 12


def test_quantiles_of_tables(spark, monkeypatch):
    """The cut and the medians that are found by ranges are those of the sorted strengths, ties included."""
    from tessellum.llm import quality_rank as q

    monkeypatch.setattr(q, "AT_ONCE", 5)
    monkeypatch.setattr(q, "RANGES", 7)
    r = np.random.default_rng(5)
    for s in (r.normal(size=301), r.integers(0, 9, 400).astype(float), np.zeros(60)):
        y = (r.random(len(s)) < 0.5 + 0.3 * np.tanh(s)).astype(int)
        y[:2] = 0, 1
        table = spark.createDataFrame([(int(b), float(a)) for a, b in zip(s, y, strict=True)], "y int, s double")
        for counts in ({0: 100, 1: 900}, {0: 500, 1: 500}, {0: int((y == 0).sum()), 1: int((y == 1).sum())}):
            weight = {k: counts[k] / (y == k).sum() for k in (0, 1)}
            assert abs(q.nearest(*q.around(table, weight, counts[0])) - q.weighted_cut(s, y, counts)) < 1e-12
        for k in (0, 1):
            assert q.median(table, k, int((y == k).sum())) == np.median(s[y == k])


def test_weights_by_plain_descent(spark):
    """Both ways to the weights against gradient descent over all pairs, written out one by one."""
    from tessellum.llm import quality_rank as q

    r = np.random.default_rng(8)
    good, bad = r.normal(0.4, 1, (25, q.N_FEATURES)), r.normal(0, 1, (31, q.N_FEATURES))
    every = np.array([a - b for a in good for b in bad])
    scale, ridge, w = np.linspace(0.5, 2, q.N_FEATURES), 0.02, np.zeros(q.N_FEATURES)
    for _ in range(20_000):
        d = every / scale
        grad = ridge * w - (d / (1 + np.exp(d @ w))[:, None]).mean(0)
        w = w - 0.3 * grad
        if np.abs(grad).max() < 1e-9:
            break
    rows = spark.createDataFrame([(int(y), i, x.tolist()) for y, own in ((1, good), (0, bad)) for i, x in enumerate(own)], "y int, i long, x array<double>")
    counts = {0: len(bad), 1: len(good)}
    made = q.pairs(rows, counts)
    assert made.count() == q.pair_count(counts) == len(every)
    for n in (len(every), None):
        assert np.abs(q.fit_pairs(made.repartition(3), scale, ridge, n=n) - w).max() < 1e-5
