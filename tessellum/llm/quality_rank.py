"""Quality by Bradley-Terry ranking.

A text's strength is a weighted sum of shape features (``text_stats``). Weights are learned from preference
pairs, a preferred and a rejected text each, by the logistic loss of the feature difference, so only
differences count. The cut is a quantile of the strengths of all labelled texts, weighed so that
each label has the share it has among all labels outside the fold; it lies at the share of rejected texts. The score is a logistic curve through ``threshold`` at the cut.

Every labelled text outside the fold takes part: in the features' scales, in at least one pair, in the cut and in the
medians. Features are counted once and kept as a table; labels meet that table, and what comes to the driver are sums, counts
of ranges of strengths, and at most AT_ONCE strengths next to a quantile. If there are at most ``most_pairs`` pairs all are taken, else each text of
the more frequent label has at least one partner, all of the other label in turn. Rows of the held-out fold,
crc32(doc_id as text) mod folds = fold, never take part.

Defined results: a null or empty text is scored as a text without words; if a label has no labelled text,
every score is 0.5; repeated rows are scored each; a row without doc_id is scored, and belongs to the fold
0 of a null's checksum, which counts as not held out. Labels without a document are ignored, and a
document with several labels counts as its least one. An empty table gives no rows, and a very long text is counted whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.plans.stages import stash

from .batches import begun, bounded_batches, map_batches, pieces, texts_of
from .text_stats import Stats
from .words import flat

MOST_PAIRS = 200_000
#: Pairs that one task may hold (13 numbers each).
PAIRS_AT_ONCE = 200_000
N_FEATURES = 13
#: Parts in which labelled texts are numbered; ranges that strengths are counted in, and how many of them are looked at one by one;
#: texts of the rarer label up to which they are broadcast.
PARTS, RANGES, AT_ONCE, BROADCAST_ROWS = 256, 4096, 10_000, 20_000


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def label_counts(labels: DataFrame, label: str, folds: int, fold: int) -> dict[int, int]:
    """How many doc_ids have each label, outside the fold."""
    return {r.y: r["count"] for r in marked(labels, label, folds, fold).groupBy("y").count().collect()}


def marked(labels: DataFrame, label: str, folds: int, fold: int) -> DataFrame:
    """doc_id and y of the labelled rows outside the fold; of several labels the least counts."""
    got = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"))
    return got.where(~in_fold(F.col("doc_id"), folds, fold))


def sample_of(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most: int) -> DataFrame:
    """doc_id, text, y of at most ``most`` labelled rows of each label outside the fold."""
    each = marked(labels, label, folds, fold).select("doc_id", "y", F.xxhash64("doc_id").alias("h"))
    least = [each.where(F.col("y") == y).orderBy("h", "doc_id").limit(most) for y in (0, 1)]
    chosen = least[0].unionByName(least[1]).select("doc_id", "y")
    return texts_of(docs).join(F.broadcast(chosen), "doc_id")  # at most 2 * most rows of two numbers


def features(docs: DataFrame) -> DataFrame:
    """doc_id and x, the features, of every text."""

    def make():
        return lambda batch: {"doc_id": batch.column("doc_id"), "x": pa.FixedSizeListArray.from_arrays(Stats(*flat(batch.column("text"))).ratios().ravel(), N_FEATURES)}

    return map_batches(texts_of(docs), make, "doc_id long, x array<double>")


def table_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


def summed(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], np.ndarray]]) -> np.ndarray:
    """The sum of what ``make()()`` gives for the batches, added up on the cluster; the driver gets one row a number of it."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, total = begun(make), None
        for batch in pieces(batches):
            got = step(batch)
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total])], ["v"])

    each = df.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("k", "v"))
    return np.array([r.v for r in sorted(each.groupBy("k").agg(F.sum("v").alias("v")).collect())])


def numbered(rows: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """y, i, x of the labelled texts, i from 0 on for each label, in an order that doc_id's hash gives; and how many each label has."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    order = Window.partitionBy("y", "part").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "x")
    rows = stash(rows.select("y", "part", "x", F.row_number().over(order).alias("place")), "labelled")
    begin, counts = [], {}
    for r in sorted(rows.groupBy("y", "part").count().collect()):
        begin.append((r.y, r.part, counts.get(r.y, 0)))
        counts[r.y] = counts.get(r.y, 0) + r["count"]
    if not begin:
        return rows, counts
    begins = rows.sparkSession.createDataFrame(begin, "y int, part int, begin long")  # at most 2 * PARTS rows
    return rows.join(F.broadcast(begins), ["y", "part"]).select("y", (F.col("begin") + F.col("place") - 1).alias("i"), "x"), counts


def pair_count(counts: dict[int, int], most_pairs: int = MOST_PAIRS) -> int:
    return max(counts.values()) * min(min(counts.values()), max(1, most_pairs // max(counts.values())))


def pairs(rows: DataFrame, counts: dict[int, int], most_pairs: int = MOST_PAIRS) -> DataFrame:
    """d, the features of a preferred text less those of a rejected one; every text is in a pair."""
    many = int(counts[1] >= counts[0])
    more, fewer = counts[many], counts[1 - many]
    each = min(fewer, max(1, most_pairs // more))
    step = fewer // each
    asked = rows.where(F.col("y") == many).select("x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda k: (F.col("i") + k * step) % fewer)).alias("i"))
    other = rows.where(F.col("y") == 1 - many).select("i", F.col("x").alias("z"))
    met = asked.join(F.broadcast(other) if fewer <= BROADCAST_ROWS else other, "i")
    return met.select(F.zip_with("x", "z", (lambda a, b: a - b) if many else (lambda a, b: b - a)).alias("d"))


def scales(rows: DataFrame) -> np.ndarray:
    """The standard deviation of each feature over all labelled texts."""

    def make():
        def step(batch):
            x = table_of(batch.column("x"))
            return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

        return step

    n, sums, squares = np.split(summed(rows.select("x"), make), [1, 1 + N_FEATURES])
    return np.maximum(np.sqrt(np.maximum(squares / n - (sums / n) ** 2, 0)), 1e-6)


def pair_sums(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number of pairs, and the sums of the loss's gradient and second derivatives at w."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
    return np.concatenate([[len(d)], (d * p[:, None]).sum(0), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])


def newton(sums: Callable[[np.ndarray], np.ndarray], ridge: float) -> np.ndarray:
    w = np.zeros(N_FEATURES)
    for _ in range(30):
        n, grad, hess = np.split(sums(w), [1, 1 + N_FEATURES])
        step = np.linalg.solve(hess.reshape(N_FEATURES, -1) / n + ridge * np.eye(N_FEATURES), ridge * w - grad / n)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_pairs(differences: DataFrame, scale: np.ndarray, ridge: float = 1e-3, *, n: int | None = None) -> np.ndarray:
    """The weights that minimise the mean of log(1 + exp(-w.(preferred - rejected))) over all pairs, by Newton steps.

    Up to PAIRS_AT_ONCE pairs (some 40 MB) are solved in one task; more of them, or an unknown number ``n``, are added up on the cluster at every step.
    """
    if n is None or n > PAIRS_AT_ONCE:

        def sums(w):
            return summed(differences, lambda: lambda batch: pair_sums(table_of(batch.column("d")) / scale, w))

        return newton(sums, ridge)
    bounded_batches(differences.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = [table_of(b.column("d")) / scale for b in batches]
        if d:
            every = np.concatenate(d)
            yield pa.RecordBatch.from_arrays([pa.array([newton(lambda w: pair_sums(every, w), ridge)])], ["w"])

    return np.array(differences.coalesce(1).mapInArrow(run, "w array<double>").first().w)


def strengths_of(rows: DataFrame, w: np.ndarray) -> DataFrame:
    """y and s, the strength, of the labelled texts."""

    def make():
        return lambda batch: {"y": batch.column("y"), "s": table_of(batch.column("x")) @ w}

    return map_batches(rows.select("y", "x"), make, "y int, s double")


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = 5, fold: int = 0, threshold: float = 0.3) -> dict | None:
    return fit_features(features(docs), labels, label, folds, fold, threshold)


def fit_features(x: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, threshold: float) -> dict | None:
    rows, counts = numbered(x.join(marked(labels, label, folds, fold), "doc_id"))
    if not counts.get(0) or not counts.get(1):
        return None
    scale = scales(rows)
    w = fit_pairs(stash(pairs(rows, counts), "pairs"), scale, n=pair_count(counts)) / scale
    strengths = stash(strengths_of(rows, w), "strengths")
    shares = label_counts(labels, label, folds, fold)
    cut = nearest(*around(strengths, {y: shares[y] / counts[y] for y in (0, 1)}, shares[0]))
    spread = max(1e-6, median(strengths, 1, counts[1]) - median(strengths, 0, counts[0]))
    return {"w": w, "cut": cut, "slope": 8.0 / spread, "at": float(np.log(threshold / (1 - threshold)))}


def around(strengths: DataFrame, weight: dict[int, float], target: float) -> tuple:
    """What ``nearest`` takes: the strengths among which the running weight reaches ``target``, found by counting in ever narrower ranges."""
    weighs = F.when(F.col("y") == 1, weight[1]).otherwise(weight[0])
    start, last, after = 0.0, None, None
    lo, hi, n = strengths.agg(F.min("s"), F.max("s"), F.count("s")).first()
    while n > AT_ONCE and lo < hi:
        inside = strengths.where(F.col("s").between(lo, hi))
        place = F.least(F.lit(RANGES - 1), F.floor((F.col("s") - lo) / F.lit(hi - lo) * RANGES)).alias("place")
        found = sorted(inside.groupBy(place).agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count("s").alias("n"), F.sum(weighs).alias("weight")).collect())
        ends = start + np.cumsum([r.weight for r in found])
        k = min(int(np.searchsorted(ends, target * (1 - 1e-12))), len(found) - 1)
        if k:
            start, last = float(ends[k - 1]), found[k - 1].hi
        if k + 1 < len(found):
            after = found[k + 1].lo
        lo, hi, n = found[k].lo, found[k].hi, found[k].n
    listed = strengths.where(F.col("s").between(lo, hi)).groupBy("s", "y").count().collect()
    return sorted((r.s, weight[r.y], r["count"]) for r in listed), target, start, last, after


def nearest(listed: list[tuple[float, float, int]], target: float, start: float = 0.0, last: float | None = None, after: float | None = None) -> float:
    """Between the strengths where the running weight comes nearest to ``target``. listed: strength, weight of one, how many, in order;
    start: the weight before them, last and after: the strengths next to them."""
    best = (abs(start - target), last, listed[0][0]) if last is not None else (np.inf, listed[0][0], listed[0][0])
    for j, (s, w, n) in enumerate(listed):
        onward = listed[j + 1][0] if j + 1 < len(listed) else after
        most = n if onward is not None else n - 1
        if most:
            k = min(max(1, round((target - start) / w)), most)
            best = min(best, (abs(start + k * w - target), s, s if k < n else onward), key=lambda x: x[0])
        start += n * w
    return float((best[1] + best[2]) / 2)


def weighted_cut(s: np.ndarray, y: np.ndarray, counts: dict[int, int]) -> float:
    """Between the strengths where the weight below comes nearest to the share of label 0 among all labels."""
    weight = {k: counts[k] / (y == k).sum() for k in (0, 1)}
    return nearest(sorted((a, weight[b], 1) for a, b in zip(s.tolist(), y.tolist(), strict=True)), counts[0])


def median(strengths: DataFrame, label: int, n: int) -> float:
    own = strengths.where(F.col("y") == label)

    def at(k: int) -> tuple[float, float | None]:
        """The strengths at places k and k + 1, the latter only if it is among those listed."""
        listed, _, start, *_ = around(own, {0: 1.0, 1: 1.0}, k + 1)
        ends = start + np.cumsum([x[2] for x in listed])
        spots = [int(np.searchsorted(ends, p)) for p in (k + 1, k + 2)]
        return listed[spots[0]][0], listed[spots[1]][0] if spots[1] < len(listed) else None

    low, high = at((n - 1) // 2)
    return low if n % 2 else float(np.mean([low, high if high is not None else at(n // 2)[0]]))


def score_array(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    return 1 / (1 + np.exp(-np.clip(model["slope"] * (x @ model["w"] - model["cut"]) + model["at"], -40, 40)))


def scored(docs: DataFrame, labels: DataFrame, *, folds: int = 5, fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold)."""
    counted = stash(features(docs), "features")
    model = fit_features(counted, labels, "quality", folds, fold, threshold)

    def make():
        return lambda batch: {"doc_id": batch.column("doc_id"), "score": score_array(model, table_of(batch.column("x")))}

    got = map_batches(counted, make, "doc_id long, score double")
    return got.select("doc_id", in_fold(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
