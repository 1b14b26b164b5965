"""Ordered profiles: gaps, runs, filters and resampling within a partition key.

All of them are windows over (key, order). A key's rows are sorted in one task and streamed; only the
hysteresis fold gathers a key's values into one array, so its keys must be profiles, not corpora.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(key: str | list[str], order: str | list[str]):
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*([order] if isinstance(order, str) else order))


def running(df: DataFrame, *, key, order, value: str) -> DataFrame:
    """Running sum, least and step from the row before."""
    w = over(key, order)
    far = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cum", F.sum(value).over(far)).withColumn("low", F.min(value).over(far)).withColumn("step", F.col(value) - F.lag(value).over(w))


def _median(a: Column) -> Column:
    s = F.sort_array(a)
    n = F.size(s)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2 + 1).cast("int"))) / 2


def hampel(df: DataFrame, *, key, order, value: str, reach: int = 3, scaled: float = 3.0, name: str = "filtered") -> DataFrame:
    """Isolated spikes replaced by the median of the rows within reach (fewer at the ends): further than ``scaled`` scaled MADs, unless the MAD is 0."""
    near = F.collect_list(value).over(over(key, order).rowsBetween(-reach, reach))
    out = df.withColumn("_near", near).withColumn("_m", _median(F.col("_near")))
    mad = F.lit(1.4826) * _median(F.transform("_near", lambda x: F.abs(x - F.col("_m"))))
    spike = (F.col("_mad") > 0) & (F.abs(F.col(value) - F.col("_m")) > scaled * F.col("_mad"))
    return out.withColumn("_mad", mad).withColumn(name, F.when(spike, F.col("_m")).otherwise(F.col(value))).drop("_near", "_m", "_mad")


def running_median(df: DataFrame, *, key, order, value: str, width: int, name: str = "smooth") -> DataFrame:
    """Median of ``width`` rows around each, the first and last rows repeated beyond the ends."""
    half, w = width // 2, over(key, order)
    whole = Window.partitionBy(*([key] if isinstance(key, str) else key))
    place, count = F.row_number().over(w), F.count("*").over(whole)
    out = df.withColumn("_near", F.collect_list(value).over(w.rowsBetween(-half, half))).withColumn("_i", place).withColumn("_n", count)
    before, after = F.greatest(F.lit(half) - F.col("_i") + 1, F.lit(0)).cast("int"), F.greatest(F.col("_i") + half - F.col("_n"), F.lit(0)).cast("int")
    padded = F.concat(F.array_repeat(F.element_at("_near", 1), before), F.col("_near"), F.array_repeat(F.element_at("_near", -1), after))
    return out.withColumn(name, _median(padded)).drop("_near", "_i", "_n")


def climb(df: DataFrame, *, key: str, order: str, value: str, least: float) -> DataFrame:
    """(key, up, down): sums over the rows kept, each of which differs from the last kept by ``least`` or more; the last row is kept always."""
    listed = df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("double")).alias("h"))
    start = F.struct(F.element_at("h", 1).alias("last"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))

    def move(s: Column, x: Column, keep: Column) -> Column:
        d = x - s["last"]
        return F.struct(F.when(keep, x).otherwise(s["last"]).alias("last"), (s["up"] + F.when(keep & (d > 0), d).otherwise(0.0)).alias("up"), (s["down"] + F.when(keep & (d < 0), -d).otherwise(0.0)).alias("down"))

    folded = F.aggregate("h", start, lambda s, x: move(s, x, F.abs(x - s["last"]) >= least))
    got = listed.withColumn("s", folded).withColumn("s", move(F.col("s"), F.element_at("h", -1), F.lit(True)))
    return got.select(key, "s.up", "s.down")


def reach_change(df: DataFrame, *, key, at: Column, value: str, reach: int, name: str = "change") -> DataFrame:
    """Change to the first row that lies ``reach`` or more further on; ``at`` must be whole numbers. Null where none does."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(at)
    ahead = F.first(value).over(w.rangeBetween(reach, Window.unboundedFollowing))
    return df.withColumn(name, ahead - F.col(value))


def fill_gaps(df: DataFrame, *, key, order: str, at: Column, value: str, name: str = "filled") -> DataFrame:
    """Null values by straight lines between their neighbours; before the first or after the last known one, that one."""
    w = over(key, order)
    past, future = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), at.cast("double"))
    v0, x0 = F.last(value, True).over(past), F.last(known, True).over(past)
    v1, x1 = F.first(value, True).over(future), F.first(known, True).over(future)
    share = (at.cast("double") - x0) / F.nullif(x1 - x0, F.lit(0.0))
    line = v0 + (v1 - v0) * share
    return df.withColumn(name, F.coalesce(F.col(value), line, v0, v1))


def islands(df: DataFrame, *, key: str, order, same: str) -> DataFrame:
    """(key, run, value, n, first, last): runs of equal values."""
    w = over(key, order)
    first = order if isinstance(order, str) else order[0]
    new = F.when(F.col(same).eqNullSafe(F.lag(same).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "run").agg(F.first(same).alias("value"), F.count("*").alias("n"), F.min(first).alias("first"), F.max(first).alias("last"))


def sessions(df: DataFrame, *, key: str, order, at: Column, gap: float, name: str = "session") -> DataFrame:
    """Numbered from 1: a new session begins where ``at`` has grown by more than the gap."""
    w = over(key, order)
    new = F.when(at - F.lag(at).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def first_sustained(df: DataFrame, *, key: str, order, holds: Column, n: int = 3, keep: str = "frame") -> DataFrame:
    """(key, first): where a condition first holds n rows in a row, the first of them."""
    w = over(key, order)
    all_hold = F.bool_and(F.coalesce(holds, F.lit(False))).over(w.rowsBetween(-(n - 1), 0)) & (F.row_number().over(w) >= n)
    start = F.lag(keep, n - 1).over(w)
    got = df.withColumn("_ok", all_hold).withColumn("_at", start).withColumn("_i", F.row_number().over(w)).where("_ok")
    return got.groupBy(key).agg(F.min_by("_at", "_i").alias("first"))


def every_kth(df: DataFrame, *, key: str, order, k: int) -> DataFrame:
    """Rows 1, k + 1, 2k + 1, ... of each key."""
    return df.withColumn("_i", F.row_number().over(over(key, order))).where((F.col("_i") - 1) % k == 0).drop("_i")


def resample(df: DataFrame, *, key: str, at: str, value: str, step: float) -> DataFrame:
    """(key, at, value): straight-line values at multiples of step between the first and the last row; ``at`` must rise."""
    w = over(key, at)
    pairs = df.select(key, F.col(at).alias("a0"), F.col(value).alias("v0"), F.lead(at).over(w).alias("a1"), F.lead(value).over(w).alias("v1"))
    grid = F.sequence(F.ceil(F.col("a0") / step), F.ceil(F.col("a1") / step) - 1)
    inner = pairs.where((F.col("a1") > F.col("a0")) & (F.ceil(F.col("a0") / step) <= F.ceil(F.col("a1") / step) - 1)).select(key, "a0", "a1", "v0", "v1", F.explode(grid).alias("k"))
    x = F.col("k") * step
    return inner.select(key, x.alias("at"), (F.col("v0") + (F.col("v1") - F.col("v0")) * (x - F.col("a0")) / (F.col("a1") - F.col("a0"))).alias("value"))


def one_per(df: DataFrame, *, by: list, order: list) -> DataFrame:
    """The first row of each group."""
    keyed = df.withColumns({f"_k{i}": b if isinstance(b, Column) else F.col(b) for i, b in enumerate(by)})
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(by))]).orderBy(*order)
    return keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", *[f"_k{i}" for i in range(len(by))])
