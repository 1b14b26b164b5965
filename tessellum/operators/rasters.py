"""Rasters as cells (r, c, value): merging, runs, shares, samples along lines; best states."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.plans.stages import ship, stash

from .drainage import drainage  # noqa: F401  (a raster operator, in a module of its own)


def merge_max(*sheets: DataFrame, value: str = "v") -> DataFrame:
    """The largest value of each cell over overlapping sheets."""
    out = sheets[0].select("r", "c", value)
    for s in sheets[1:]:
        out = out.unionByName(s.select("r", "c", value))
    return out.groupBy("r", "c").agg(F.max(value).alias(value))


def row_runs(cells: DataFrame, *, value: str = "v") -> DataFrame:
    """(r, value, c0, c1): runs of equal neighbours in a row, end exclusive."""
    w = Window.partitionBy("r", value).orderBy("c")
    k = cells.where(F.col(value).isNotNull()).withColumn("_g", F.col("c") - F.row_number().over(w))
    return k.groupBy("r", value, "_g").agg(F.min("c").alias("c0"), (F.max("c") + 1).alias("c1")).drop("_g")


def class_shares(cells: DataFrame, row_area: DataFrame, *, value: str = "v") -> DataFrame:
    """(value, area, percent): cells weighted by the area of their row."""
    got = cells.groupBy("r", value).agg(F.count("*").alias("n")).join(row_area.select("r", F.col("area").alias("a")), "r").groupBy(value).agg(F.sum(F.col("n") * F.col("a")).alias("area"))
    return got.crossJoin(F.broadcast(got.agg(F.sum("area").alias("all")))).select(value, "area", (100 * F.col("area") / F.nullif(F.col("all"), F.lit(0.0))).alias("percent"))


def samples(lines: DataFrame, *, key: str, step: float) -> DataFrame:
    """(key, i, x, y, d): points every ``step`` along straight pieces (x0, y0, x1, y1), both ends included; d is the length a point stands for."""
    size = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    n = F.greatest(F.ceil(size / step), F.lit(1))
    t = F.col("i") / F.col("n")
    got = lines.withColumn("n", n).withColumn("size", size).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    return got.select(key, "i", (F.col("x0") + (F.col("x1") - F.col("x0")) * t).alias("x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * t).alias("y"), (F.col("size") / (F.col("n") + 1)).alias("d"))


def lines_in_mask(lines: DataFrame, cells: DataFrame, *, key: str, step: float, exempt: Column | None = None) -> DataFrame:
    """(key, inside, length): whether any sample lies in a cell of the mask (r = floor(y), c = floor(x)), and the length in it."""
    asked = lines if exempt is None else lines.where(~exempt)
    at = samples(asked, key=key, step=step).withColumn("r", F.floor("y")).withColumn("c", F.floor("x"))
    hit = at.join(cells.select("r", "c").distinct().withColumn("hit", F.lit(True)), ["r", "c"], "left")
    got = hit.groupBy(key).agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("inside"), F.sum(F.when(F.col("hit"), F.col("d")).otherwise(0.0)).alias("length"))
    return lines.select(key).distinct().join(got, key, "left").select(key, F.coalesce("inside", F.lit(False)).alias("inside"), F.coalesce("length", F.lit(0.0)).alias("length"))


def best_shift(a: DataFrame, b: DataFrame, *, reach: int = 4) -> DataFrame:
    """(dr, dc, iou) of the shift of mask b within reach that overlaps mask a most; the smaller shift on ties."""
    step = F.sequence(F.lit(-reach), F.lit(reach))
    na, nb = a.agg(F.count("*").alias("na")), b.agg(F.count("*").alias("nb"))
    moved = b.select("r", "c", F.explode(step).alias("dr")).select("r", "c", "dr", F.explode(step).alias("dc"))
    both = moved.select((F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), "dr", "dc").join(a.select("r", "c"), ["r", "c"]).groupBy("dr", "dc").agg(F.count("*").alias("k"))
    scored = both.crossJoin(F.broadcast(na)).crossJoin(F.broadcast(nb)).withColumn("iou", F.col("k") / (F.col("na") + F.col("nb") - F.col("k")))
    return scored.orderBy(F.desc("iou"), F.abs("dr") + F.abs("dc"), "dr", "dc").limit(1).select("dr", "dc", "iou")


#: Samples of a route that are joined into one piece, and pieces into a longer one; numbers of the costs that one group of pieces holds, roughly.
FAN, HELD = 256, 1_500_000


class _Pieces:
    """The rows of many pieces, for one step of all of them at once; lists are filled up to the longest, costs with infinity."""

    def __init__(self, pdf: pd.DataFrame, single: bool):
        pdf = pdf.sort_values(["route", "up", "pos"]).reset_index(drop=True)
        self.rows, self.single = pdf, single
        new = (pdf["route"].ne(pdf["route"].shift()) | pdf["up"].ne(pdf["up"].shift())).to_numpy()
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(pdf)))
        # the longest first: a step has the first so many of them
        order = np.argsort(-size, kind="stable")
        self.begin, self.size = begin[order], size[order]
        self.a, self.b = (pdf[c].map(len).to_numpy("int64") for c in ("first", "last"))
        self.width = w = int(max(self.a.max(), self.b.max()))
        at = np.arange(w)
        inside = lambda n: at[None, :] < n[:, None]
        self.first, self.last = (self._filled(pdf[c], inside(n), 0.0) for c, n in (("first", self.a), ("last", self.b)))
        self.cost = self._filled(pdf["cost"], inside(self.a) if single else inside(self.a)[:, :, None] & inside(self.b)[:, None, :], np.inf)

    @staticmethod
    def _filled(lists: pd.Series, inside: np.ndarray, fill: float) -> np.ndarray:
        out = np.full(inside.shape, fill)
        out[inside] = np.concatenate(lists.to_list())
        return out

    def step(self, k: int) -> np.ndarray:
        """The rows of that place in their pieces."""
        return self.begin[: np.searchsorted(-self.size, -k, side="left")] + k

    def whole(self, rows: np.ndarray) -> np.ndarray:
        """Costs from each state at the beginning to each at the end; a single sample has costs of its states alone."""
        return np.where(np.eye(self.width, dtype=bool), self.cost[rows][:, None, :], np.inf) if self.single else self.cost[rows]

    def turns(self, rows: np.ndarray, turn: float) -> np.ndarray:
        """Costs from the states at the end of the rows before to those at the beginning of the rows."""
        return np.abs(self.last[rows - 1][:, :, None] - self.first[rows][:, None, :]) * turn


def _least(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The min-plus products."""
    out = left[:, :, :1] + right[:, :1, :]
    for m in range(1, left.shape[2]):
        np.minimum(out, left[:, :, m : m + 1] + right[:, m : m + 1, :], out=out)
    return out


def _joined(turn: float, single: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = _Pieces(pdf, single)
        whole = p.whole(p.begin)
        for k in range(1, int(p.size[0])):
            rows = p.step(k)
            into = _least(whole[: len(rows)], p.turns(rows, turn))
            whole[: len(rows)] = into + p.cost[rows][:, None, :] if single else _least(into, p.cost[rows])
        end = p.begin + p.size - 1
        head, tail = p.rows.iloc[p.begin], p.rows.iloc[end]
        cost = [c[:a, :b].ravel() for c, a, b in zip(whole, p.a[p.begin].tolist(), p.b[end].tolist(), strict=True)]
        return pd.DataFrame({"route": head["route"].to_numpy(), "pos": head["up"].to_numpy(), "first": head["first"].to_numpy(), "last": tail["last"].to_numpy(), "cost": cost})

    return run


def _traced(turn: float, single: bool):
    """Given the states at both ends of pieces (places in their lists), those at both ends of each of their parts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = _Pieces(pdf, single)
        n, w = len(p.rows), p.width
        a, b = p.rows["a"].to_numpy("int64"), p.rows["b"].to_numpy("int64")
        # least cost from the beginning to the end of each part, and to the beginning of the next
        reach, into = np.empty((n, w)), np.empty((n, w))
        reach[p.begin] = p.whole(p.begin)[np.arange(len(p.begin)), a[p.begin]]
        for k in range(1, int(p.size[0])):
            rows = p.step(k)
            into[rows] = (reach[rows - 1][:, :, None] + p.turns(rows, turn)).min(1)
            reach[rows] = into[rows] + p.cost[rows] if single else (into[rows][:, :, None] + p.cost[rows]).min(1)
        enter, end = a.copy(), b.copy()
        for k in range(int(p.size[0]) - 1, 0, -1):
            rows = p.step(k)
            each = np.arange(len(rows))
            enter[rows] = (into[rows] + p.whole(rows)[each, :, end[rows]]).argmin(1)
            to = p.first[rows, enter[rows]]
            # only states that there are; the first of the cheapest
            way = np.where(np.arange(w)[None, :] < p.b[rows - 1][:, None], reach[rows - 1] + np.abs(p.last[rows - 1] - to[:, None]) * turn, np.inf)
            end[rows - 1] = way.argmin(1)
        return pd.DataFrame({"route": p.rows["route"], "pos": p.rows["pos"], "a": enter, "b": end})

    return run


def best_states(samples_: DataFrame, *, turn: float, fan: int = FAN) -> DataFrame:
    """(route, seq, state): the cheapest sequence of states over ``samples_`` (route, seq, state, cost), each with its own cost and ``turn`` for every unit of change.

    A piece of a route is the least cost from every state at its beginning to every state at its end; pieces join by min-plus products. ``fan`` samples make a piece, ``fan`` pieces
    a longer one, and so on up to the route; then the states at the ends of pieces are traced back down. So no route has to fit a task: pieces are dealt in groups of bounded size
    (but for one piece), and each step is taken for all pieces of a group at once.
    """
    spark = samples_.sparkSession
    ship(spark)
    turn, item = float(turn), "route string, pos long, first array<double>, last array<double>, cost array<double>"
    listed = samples_.groupBy("route", "seq").agg(F.array_sort(F.collect_list(F.struct(F.col("state").cast("double").alias("state"), F.col("cost").cast("double").alias("cost")))).alias("l"))
    listed = stash(listed.select(F.col("route").cast("string").alias("route"), F.col("seq").cast("long").alias("seq"), F.col("l.state").alias("state"), F.col("l.cost").alias("cost")), "samples")
    begins = stash(listed.groupBy("route").agg(F.min("seq").alias("_from")), "begins")  # places count from a route's beginning
    level = stash(listed.join(begins, "route").select("route", (F.col("seq") - F.col("_from")).alias("pos"), F.col("state").alias("first"), F.col("state").alias("last"), "cost"), "states")
    levels, groups = [level], []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = F.greatest(F.size("first"), F.size("last")).cast("long")
    while True:
        far, held = levels[-1].agg(F.max("pos"), F.sum(size * size)).first()
        if len(levels) > 1 and not far:
            break
        groups.append(max(parts, -(-(held or 0) // HELD)))
        levels[-1] = levels[-1].withColumn("up", F.floor(F.col("pos") / fan).cast("long")).withColumn("_group", F.pmod(F.xxhash64("route", "up"), F.lit(groups[-1])))
        levels.append(stash(levels[-1].groupBy("_group").applyInPandas(_joined(turn, len(levels) == 1), item), "pieces"))
    top = levels.pop()
    # of equally cheap ends the least last state counts
    last = F.expr("array_min(transform(filter(sequence(0, size(cost) - 1), i -> cost[i] = array_min(cost)), i -> i % size(last)))")
    begin = F.expr("filter(sequence(0, size(first) - 1), i -> cost[i * size(last) + b] = array_min(cost))[0]")
    picked = top.select("route", "pos", "cost", "first", "last", last.alias("b")).select("route", "pos", begin.alias("a"), "b")
    for k in reversed(range(len(levels))):
        down = levels[k].join(picked.select("route", F.col("pos").alias("up"), "a", "b"), ["route", "up"])
        picked = stash(down.groupBy("_group").applyInPandas(_traced(turn, k == 0), "route string, pos long, a int, b int"), "traced")
    return levels[0].select("route", "pos", "first").join(picked, ["route", "pos"]).join(begins, "route").select("route", (F.col("pos") + F.col("_from")).alias("seq"), F.col("first")[F.col("b")].alias("state"))


def tile_error(corners: DataFrame, *, x: str, y: str) -> DataFrame:
    """(key, corner, bend): how far a tile's fourth corner is from the parallelogram of the others, and the largest distance of its middle."""
    pick = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    got = corners.groupBy("key").agg(*[pick(c, i).alias(f"{c}{i}") for c in (x, y) for i in range(5)])
    corner = F.hypot(*[F.col(f"{c}3") - (F.col(f"{c}1") + F.col(f"{c}2") - F.col(f"{c}0")) for c in (x, y)])
    bend = F.hypot(*[F.col(f"{c}4") - (F.col(f"{c}0") + F.col(f"{c}1") + F.col(f"{c}2") + F.col(f"{c}3")) / 4 for c in (x, y)])
    return got.select("key", corner.alias("corner"), bend.alias("bend"))
