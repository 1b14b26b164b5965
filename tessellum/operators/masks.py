"""Masks and classes on grids: exact distances, holes, growth into what is unclassified, and majorities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellum.plans.stages import ship, stash

from .components import components


def _envelope(rows: np.ndarray, squares: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """At each asked row the least of the parabolas (row - rows)**2 + squares, by their lower envelope; rows ascend."""
    at, starts = [0], [-np.inf]
    for k in range(1, len(rows)):
        while True:
            j = at[-1]
            meet = ((squares[k] + rows[k] ** 2) - (squares[j] + rows[j] ** 2)) / (2 * (rows[k] - rows[j]))
            if meet > starts[-1]:
                break
            at.pop()
            starts.pop()
        at.append(k)
        starts.append(meet)
    best = np.array(at)[np.searchsorted(np.array(starts), asked, "right") - 1]
    out = np.empty(len(asked))
    # where two parabolas meet between whole rows rounding may have taken the neighbour
    spots = np.array(at)
    place = np.searchsorted(spots, best)
    for shift in (-1, 0, 1):
        k = spots[np.clip(place + shift, 0, len(spots) - 1)]
        d = (asked - rows[k]) ** 2 + squares[k]
        out = d if shift == -1 else np.minimum(out, d)
    return out


def _columns(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One column of the grid, for every kind that has sources in any of the rows."""
    asked = pdf.loc[~pdf["source"], "r"].to_numpy(np.int64)
    out = []
    for kind, own in pdf[pdf["source"]].sort_values("r").groupby("kind"):
        d2 = _envelope(own["r"].to_numpy(np.float64), own["square"].to_numpy(np.float64), asked.astype(np.float64))
        out.append(pd.DataFrame({"kind": kind, "r": asked, "c": key[0], "d2": d2.astype(np.int64)}))
    return pd.concat(out) if out and len(asked) else pd.DataFrame({"kind": [], "r": [], "c": [], "d2": []})


def square_distances(sources: DataFrame, over: DataFrame) -> DataFrame:
    """(kind, r, c, d2): for every cell of ``over`` (r, c) and every kind of ``sources`` (kind, r, c) the exact square of the distance to the nearest cell of that kind.

    Along rows the nearest source on either side is looked up in order; down the columns the parabolas of all rows have a lower envelope. So a row, and
    then a column, is what meets in a task. Only rows with sources are spread over the columns asked for.
    """
    ship(sources.sparkSession)
    over = over.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct()
    own = sources.select("kind", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct()
    low, high = over.agg(F.min("c"), F.max("c")).first()
    if low is None:
        return sources.sparkSession.createDataFrame([], f"kind {dict(sources.dtypes)['kind']}, r long, c long, d2 long")
    spread = own.select("kind", "r").distinct().select("kind", "r", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long"))).alias("c"), F.lit(None).cast("long").alias("s"))
    both = own.select("kind", "r", "c", F.col("c").alias("s")).unionByName(spread)
    w = Window.partitionBy("kind", "r").orderBy("c")
    before, after = F.last("s", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.first("s", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    near = both.withColumn("_d", F.least(F.col("c") - before, after - F.col("c"))).where("s IS NULL")
    source = near.select("kind", "r", "c", (F.col("_d") * F.col("_d")).alias("square"), F.lit(True).alias("source"))
    kind = dict(sources.dtypes)["kind"]
    asked = over.select(F.lit(None).cast(kind).alias("kind"), "r", "c", F.lit(0).cast("long").alias("square"), F.lit(False).alias("source"))
    return source.unionByName(asked).groupBy("c").applyInPandas(_columns, f"kind {kind}, r long, c long, d2 long")


def distances(mask: DataFrame, over: DataFrame, *, limit: float | None = None) -> DataFrame:
    """(r, c, dist): the distance of each cell of ``over`` to the nearest cell of the mask (r, c), no more than the limit if there is one; no rows without a mask."""
    got = square_distances(mask.withColumn("kind", F.lit(0)), over).withColumn("dist", F.sqrt("d2"))
    return got.select("r", "c", F.least("dist", F.lit(float(limit))).alias("dist") if limit is not None else "dist")


def grown(cells: DataFrame, into: DataFrame, *, reach: float) -> DataFrame:
    """(r, c, kind, d2): cells of ``into`` (r, c) with the kind of the nearest cell of ``cells`` (r, c, kind) within reach, the least kind on ties.

    One distance field a kind; kinds must be few, since every cell is asked once for each.
    """
    got = square_distances(cells.select("kind", "r", "c"), into).where(F.col("d2") <= reach * reach)
    return got.groupBy("r", "c").agg(F.min(F.struct("d2", "kind")).alias("m")).select("r", "c", "m.kind", "m.d2")


def majority(cells: DataFrame, *, size: int, least: int, among: DataFrame) -> DataFrame:
    """(r, c, kind, n): for the cells of ``among`` (r, c) the most frequent kind of ``cells`` (r, c, kind) in the square of ``size`` around them, the least kind on ties, where it stands there ``least`` times."""
    half = F.sequence(F.lit(-(size // 2)), F.lit(size // 2))
    rows = cells.withColumn("_d", F.explode(half)).groupBy("kind", (F.col("r") + F.col("_d")).cast("long").alias("r"), F.col("c").cast("long").alias("c")).agg(F.count("*").alias("n"))
    square = rows.withColumn("_d", F.explode(half)).groupBy("kind", "r", (F.col("c") + F.col("_d")).alias("c")).agg(F.sum("n").alias("n"))
    best = square.groupBy("r", "c").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("kind").alias("kind"))).alias("m"))
    return best.join(among.select("r", "c").distinct(), ["r", "c"], "left_semi").select("r", "c", "m.kind", (-F.col("m.n")).alias("n")).where(F.col("n") >= least)


def majority_filled(cells: DataFrame, empty: DataFrame, *, size: int = 5, least: int = 6, rounds: int = 3) -> DataFrame:
    """(r, c, kind): the classified cells and, round after round, those of ``empty`` (r, c) that enough cells of one kind surround."""
    now, left = stash(cells.select("r", "c", "kind"), "classes"), empty.select("r", "c")
    for _ in range(rounds):
        new = majority(now, size=size, least=least, among=left).select("r", "c", "kind")
        now = stash(now.unionByName(new), "classes")
        left = left.join(now.select("r", "c"), ["r", "c"], "left_anti")
    return now


def smoothed_classes(cells: DataFrame, *, size: int = 3, least: int = 5) -> DataFrame:
    """(r, c, kind): every classified cell takes the kind of the majority around it, where one stands there ``least`` times."""
    most = majority(cells, size=size, least=least, among=cells).withColumnRenamed("kind", "most")
    return cells.join(most.select("r", "c", "most"), ["r", "c"], "left").select("r", "c", F.coalesce("most", "kind").alias("kind"))


def holes(mask: DataFrame) -> DataFrame:
    """(r, c): cells outside the mask (r, c) from which no way over sides leads around it.

    Ways go over the cells outside within the mask's bounds and one cell more; these are generated row by row. What is connected to the
    corner of that frame is outside.
    """
    mask = mask.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct()
    r0, r1, c0, c1 = mask.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()
    if r0 is None:
        return mask
    wide = c1 - c0 + 3
    frame = mask.sparkSession.range((r1 - r0 + 3) * wide).select((F.floor(F.col("id") / wide) + r0 - 1).alias("r"), (F.col("id") % wide + c0 - 1).alias("c"), F.col("id").alias("node"))
    free = stash(frame.join(mask, ["r", "c"], "left_anti"), "free")
    # runs of free cells in a row are one node, so wide open stretches are few
    w = Window.partitionBy("r").orderBy("c")
    runs = free.withColumn("_g", F.col("c") - F.row_number().over(w))
    runs = stash(runs.select("r", "c", F.min("node").over(Window.partitionBy("r", "_g")).alias("run")), "runs")
    links = runs.join(runs.select((F.col("r") - 1).alias("r"), "c", F.col("run").alias("to")), ["r", "c"]).select("run", "to").distinct()
    outside = components(links, "run", "to").where("component = 0").select(F.col("node").alias("run"))
    return runs.join(outside, "run", "left_anti").select("r", "c")


def filled(mask: DataFrame) -> DataFrame:
    """The mask (r, c) with its holes."""
    return mask.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct().unionByName(holes(mask))
