"""Statistics: axial means, ranks of p-values, slopes, resampling and null distributions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.plans.stages import ship, stash


def axial_mean(angle: Column, weight: Column, period: float) -> list[Column]:
    """(mean, r): weighted mean of angles in degrees that repeat with the period, and its concentration."""
    a = F.radians(angle * (360.0 / period))
    c, s, n = F.sum(weight * F.cos(a)), F.sum(weight * F.sin(a)), F.sum(weight)
    return [F.pmod(F.degrees(F.atan2(s, c)) * (period / 360.0), F.lit(period)).alias("mean"), (F.sqrt(c * c + s * s) / F.nullif(n, F.lit(0.0))).alias("r")]


def bh_qvalues(tests: DataFrame, *, p: str, key: str, name: str = "q") -> DataFrame:
    """Benjamini-Hochberg q-values of a family of tests (one row each; a family is small and stands in one task)."""
    whole = Window.partitionBy()
    ranked = tests.withColumn("_r", F.row_number().over(Window.orderBy(p, key))).withColumn("_m", F.count("*").over(whole))
    down = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(name, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(down))).drop("_r", "_m")


def theil_sen(df: DataFrame, *, by: str, x: str, y: str) -> DataFrame:
    """(by, slope): median slope of all pairs of a group's points with different x; groups must be small profiles."""
    a, b = df.select(by, F.col(x).alias("x0"), F.col(y).alias("y0")), df.select(by, F.col(x).alias("x1"), F.col(y).alias("y1"))
    return a.join(b, by).where("x0 < x1").groupBy(by).agg(F.median((F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))).alias("slope"))


def detrended_corr(df: DataFrame, *, by: str, x: str, a: str, b: str) -> DataFrame:
    """(by, r): correlation of a and b after each loses its straight line in x, from one pass of sums."""
    c = {f"{i}{j}": F.covar_pop(i, j) for i, j in ((x, a), (x, b), (a, b))}
    got = df.groupBy(by).agg(*[v.alias(f"c_{k}") for k, v in c.items()], *[F.var_pop(k).alias(f"v_{k}") for k in (x, a, b)])
    cx, cy, vx = F.col(f"c_{x}{a}"), F.col(f"c_{x}{b}"), F.nullif(F.col(f"v_{x}"), F.lit(0.0))
    cov = F.col(f"c_{a}{b}") - cx * cy / vx
    return got.select(by, (cov / F.nullif(F.sqrt((F.col(f"v_{a}") - cx * cx / vx) * (F.col(f"v_{b}") - cy * cy / vx)), F.lit(0.0))).alias("r"))


def mad(df: DataFrame, *, by: str, value: str) -> DataFrame:
    """(by, median, mad): two passes, the second against the first's medians."""
    mid = df.groupBy(by).agg(F.median(value).alias("median"))
    return df.join(mid, by).groupBy(by, "median").agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))


def block_bootstrap(df: DataFrame, *, value: str, order: str, block: int, draws: int, seed: int, levels=(0.025, 0.975)) -> DataFrame:
    """(low, high): percentile interval of the mean over moving blocks.

    Blocks are first summed, one row each; a draw picks as many blocks as fill the series, by an MD5 of
    the seed and the place among all draws, so the result doesn't depend on partitions. ``draws`` times the number of blocks rows.
    """
    rows = df.select(F.col(value).alias("v"), F.row_number().over(Window.orderBy(order)).alias("i"))
    n = rows.count()
    if n < block:
        raise ValueError("the series is shorter than a block")
    w = Window.orderBy("i").rowsBetween(0, block - 1)
    blocks = rows.select((F.col("i") - 1).alias("b"), F.sum("v").over(w).alias("s")).where(F.col("b") <= n - block)
    places = -(-n // block)
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 12), 16, 10).cast("long")
    picks = df.sparkSession.range(draws * places).select((F.col("id") / places).cast("long").alias("draw"), (drawn % (n - block + 1)).alias("b"))
    means = picks.join(blocks, "b").groupBy("draw").agg((F.sum("s") / (places * block)).alias("m"))
    p = F.percentile("m", F.array(*[F.lit(x) for x in levels]))
    return means.agg(p.alias("p")).select(F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


#: Primes with roots of unity of all orders up to 2**25 and 2**23, and a generator of each: fixed values.
PRIMES = ((167772161, 3), (998244353, 3))


def _transform(a: np.ndarray, w: int, p: int) -> np.ndarray:
    """The sums of a[i] * w**(i * k) modulo p for all k; w is a root of unity whose order is the length, a power of two."""
    if len(a) == 1:
        return a
    even, odd = _transform(a[::2], w * w % p, p), _transform(a[1::2], w * w % p, p)
    turned = _powers(w, len(odd), p) * odd % np.uint64(p)
    return np.concatenate([(even + turned) % np.uint64(p), (even + np.uint64(p) - turned) % np.uint64(p)])


def _powers(w: int, n: int, p: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(w, len(out), p)) % np.uint64(p)])
    return out[:n]


def _roots(rows: int, cols: int) -> list[tuple[int, int, int, int]]:
    """For each prime: p and roots of order rows * cols, rows and cols."""
    return [(p, w := pow(g, (p - 1) // (rows * cols), p), pow(w, cols, p), pow(w, rows, p)) for p, g in PRIMES]


def _filled(pdf: pd.DataFrame, place: str, value: str, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    out[pdf[place].to_numpy()] = pdf[value].to_numpy().astype(np.uint64)
    return out


def correlations(series: DataFrame, *, at: str, a: str, b: str) -> DataFrame:
    """(k, t): the sum of a[i] * b[(i + k) mod n] for every shift k of two ring-shaped series of whole numbers at 0 to n - 1, exactly.

    Both are transformed modulo two primes, as a table of some sqrt(2n) rows and columns: down the columns, along the rows, where the products are taken and turned back, and down the
    columns again. So a task holds a row or a column, and n log n steps do for all shifts. A sum must stay within 8e16; n is 2**22 at most.
    """
    spark = series.sparkSession
    ship(spark)
    n, top_a, top_b = series.agg(F.count("*"), F.max(F.abs(a)), F.max(F.abs(b))).first()
    if not n:
        return spark.createDataFrame([], "k long, t long")
    bits = max(1, (2 * n - 1).bit_length())
    rows, cols = 1 << bits // 2, 1 << bits - bits // 2
    if bits > 23 or n * int(top_a or 0) * int(top_b or 0) >= PRIMES[0][0] * PRIMES[1][0] // 2:
        raise ValueError("the series is too long or its numbers are too large")

    def columns(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"s": key[0], "c": key[1], "r": np.arange(rows)}
        for q, (p, w, by_row, _) in enumerate(_roots(rows, cols)):
            if key[0] == 0:  # the first series against the sense of the second, which makes the product a correlation
                w, by_row = pow(w, -1, p), pow(by_row, -1, p)
            got = _transform(_filled(pdf, "r", f"v{q}", rows), by_row, p)
            out[f"v{q}"] = (got * _powers(pow(w, int(key[1]), p), rows, p) % np.uint64(p)).astype(np.int64)
        return pd.DataFrame(out)

    def along(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"r": key[0], "c": np.arange(cols)}
        for q, (p, w, _, by_col) in enumerate(_roots(rows, cols)):
            one = _transform(_filled(pdf[pdf["s"] == 0], "c", f"v{q}", cols), pow(by_col, -1, p), p)
            two = _transform(_filled(pdf[pdf["s"] == 1], "c", f"v{q}", cols), by_col, p)
            back = _transform(one * two % np.uint64(p), pow(by_col, -1, p), p)
            out[f"v{q}"] = (back * _powers(pow(pow(w, -1, p), int(key[0]), p), cols, p) % np.uint64(p)).astype(np.int64)
        return pd.DataFrame(out)

    def ends(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for q, (p, _, by_row, _) in enumerate(_roots(rows, cols)):
            got = _transform(_filled(pdf, "r", f"v{q}", rows), pow(by_row, -1, p), p)
            found.append([int(x) * pow(rows * cols, -1, p) % p for x in got])
        (p, _), (q, _) = PRIMES
        whole = [x + p * ((y - x) * pow(p, -1, q) % q) for x, y in zip(*found, strict=True)]
        return pd.DataFrame({"i": np.arange(rows) * cols + key[0], "t": [x - p * q if x > p * q // 2 else x for x in whole]})

    value = lambda c, p: F.pmod(F.col(c).cast("long"), F.lit(p)).alias
    place = [F.floor(F.col(at) / cols).cast("long").alias("r"), (F.col(at) % cols).cast("long").alias("c")]
    both = [series.select(F.lit(k).alias("s"), *place, *(value(c, p)(f"v{q}") for q, (p, _) in enumerate(PRIMES))) for k, c in enumerate((a, b))]
    # columns without any value stay zero and are left out
    down = both[0].unionByName(both[1]).groupBy("s", "c").applyInPandas(columns, "s int, c long, r long, v0 long, v1 long")
    across = down.groupBy("r").applyInPandas(along, "r long, c long, v0 long, v1 long")
    straight = across.groupBy("c").applyInPandas(ends, "i long, t long")
    # shifts below zero stand at the end of the table
    k = F.when(F.col("i") < n, F.col("i")).otherwise(F.col("i") - rows * cols + n)
    return straight.where((F.col("i") < n) | (F.col("i") > rows * cols - n)).groupBy(k.alias("k")).agg(F.sum("t").alias("t"))


def shift_null(series: DataFrame, *, at: str, a: str, b: str, decimals: tuple[int, int] = (0, 0)) -> DataFrame:
    """(observed, p): mean product of two ring-shaped series against all circular shifts of one; (number as large + 1) / (shifts + 1).

    The series' values are taken as whole numbers of 10**-decimals, so sums are exact and ties are ties.
    """
    scale = [10 ** d for d in decimals]
    whole = series.select(at, *(F.round(F.col(c) * s).cast("long").alias(n) for c, s, n in ((a, scale[0], "_a"), (b, scale[1], "_b"))))
    stat = stash(correlations(whole, at=at, a="_a", b="_b"), "correlations")
    n = stat.count()
    seen = stat.where("k = 0").select(F.col("t").alias("seen"))
    counts = stat.where("k > 0").crossJoin(F.broadcast(seen)).agg(F.count_if(F.col("t") >= F.col("seen")).alias("as_large"))  # one row
    return seen.crossJoin(counts).select((F.col("seen") / (n * scale[0] * scale[1])).alias("observed"), ((F.col("as_large") + 1) / n).alias("p"))


def overlap_scores(cells: DataFrame, *, a: Column, b: Column) -> DataFrame:
    """(iou, precision, recall) of two masks over the same cells."""
    both, either = F.count_if(a & b), F.count_if(a | b)
    ratio = lambda x, y: x / F.nullif(y, F.lit(0))
    return cells.agg(ratio(both, either).alias("iou"), ratio(both, F.count_if(a)).alias("precision"), ratio(both, F.count_if(b)).alias("recall"))


def band_table(df: DataFrame, *, distance: Column, edges: list[float], value: str, least: int = 5) -> DataFrame:
    """(band, n, median) of half-open bands; bands with fewer rows than the least are left out."""
    band = sum((F.when(distance >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1
    return df.withColumn("band", band).where((F.col("band") >= 0) & (F.col("band") < len(edges) - 1)).groupBy("band").agg(F.count("*").alias("n"), F.median(value).alias("median")).where(F.col("n") >= least)
