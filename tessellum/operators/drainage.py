"""Drainage of large grids in tiles: fill levels, flow directions and what drains through each cell.

A cell's fill level is the least, over all ways to the rim, of the highest cell on the way. A rim cell, one with a missing neighbour among the eight, drains off
the grid. Any other cell drains to its neighbour of least (level, distance, row, column), where the distance counts steps over cells of the same level to the next
cell that has a lower neighbour or is a rim cell. So the result doesn't depend on the tiles.

Only a tile and the ring of cells around it meet in one task. Tiles are filled alone, which gives passes between their outer cells; the lowest passes
to the rim are those of a minimal spanning tree over all tiles' passes, solved in rounds on the cluster; then tiles are filled again from their outer cells' levels.
Distances go over tile borders in rounds, as many as tiles that a level stretch crosses. Flow is summed in each tile, then over the exits of all tiles by doubling, then in the tiles
once more.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.plans.stages import ship, stash

from .chains import follow, gathered, running
from .trees import spanning_forest, tour

NEAR = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
FAR = 1 << 40


def _name(grid: str, r: str, c: str):
    return F.concat_ws("/", F.col(grid), F.col(r).cast("string"), F.col(c).cast("string"))


def haloed(cells: DataFrame, size: int) -> DataFrame:
    """``cells`` (grid, r, c, ...) once for their own tile (tr, tc) of ``size`` by ``size`` and once for every other tile that they touch."""
    own = [F.floor(F.col(k) / size) for k in ("r", "c")]
    near = [F.array_distinct(F.array(*[F.floor((F.col(k) + d) / size) for d in (-1, 0, 1)])) for k in ("r", "c")]
    each = cells.withColumn("tr", F.explode(near[0])).withColumn("tc", F.explode(near[1]))
    return each.withColumn("own", (F.col("tr") == own[0]) & (F.col("tc") == own[1]))


class Tile:
    """A tile's cells as arrays with a margin of one cell all around; ``own``: of the tile; ``there``: on the grid."""

    def __init__(self, pdf: pd.DataFrame):
        own = pdf["own"].to_numpy(bool)
        self.r0, self.c0 = int(pdf["r"][own].min()) - 1, int(pdf["c"][own].min()) - 1
        self.at = (pdf["r"].to_numpy(np.int64) - self.r0, pdf["c"].to_numpy(np.int64) - self.c0)
        shape = int(pdf["r"][own].max()) - self.r0 + 2, int(pdf["c"][own].max()) - self.c0 + 2
        # cells of the ring beyond what the tile's own cells touch are of no use
        self.used = (self.at[0] >= 0) & (self.at[1] >= 0) & (self.at[0] < shape[0]) & (self.at[1] < shape[1])
        self.there, self.own = np.zeros(shape, bool), np.zeros(shape, bool)
        self.there[self.at[0][self.used], self.at[1][self.used]] = True
        self.own[self.at[0][own], self.at[1][own]] = True
        self.pdf, self.shape = pdf, shape

    def array(self, column: str, fill: float) -> np.ndarray:
        out = np.full(self.shape, fill, float)
        values = self.pdf[column].to_numpy(float)
        out[self.at[0][self.used], self.at[1][self.used]] = np.where(np.isnan(values), fill, values)[self.used]
        return out

    def beside(self, mask: np.ndarray) -> np.ndarray:
        """Cells with a neighbour in the mask."""
        wide = np.pad(mask, 1)
        rows, cols = mask.shape
        return np.logical_or.reduce([wide[1 + a : 1 + a + rows, 1 + b : 1 + b + cols] for a, b in NEAR])

    def rim(self) -> np.ndarray:
        return self.own & self.beside(~self.there)

    def outer(self) -> np.ndarray:
        """Own cells with a neighbour that isn't the tile's own."""
        return self.own & self.beside(~self.own)

    def neighbours(self, i: int, j: int):
        for a, b in NEAR:
            if self.there[i + a, j + b]:
                yield i + a, j + b

    def frame(self, key: tuple, mask: np.ndarray, **columns) -> pd.DataFrame:
        i, j = np.nonzero(mask)
        return pd.DataFrame({"grid": key[0], "r": i + self.r0, "c": j + self.c0, **{n: x[i, j] for n, x in columns.items()}})


def _flood(tile: Tile, height: np.ndarray, seeds: np.ndarray, level: np.ndarray, visit=None) -> np.ndarray:
    """Levels from the seeds inwards, lowest first; ``visit(a, b)`` is called for neighbours that are both reached."""
    out, heap = level.copy(), [(level[s], *s) for s in zip(*np.nonzero(seeds), strict=True)]
    heapq.heapify(heap)
    done, own = seeds.copy(), tile.own
    while heap:
        low, i, j = heapq.heappop(heap)
        for a, b in NEAR:
            k = (i + a, j + b)
            if not own[k]:
                continue
            if not done[k]:
                done[k] = True
                out[k] = max(low, height[k])
                heapq.heappush(heap, (out[k], *k))
                if visit:
                    visit((i, j), k, True)
            elif visit:
                visit((i, j), k, False)
    return out


def _passes(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Passes between a tile's outer cells, to those of the tiles around, and to the outside."""
    tile = Tile(pdf)
    height, outer, rim = tile.array("v", np.nan), tile.outer(), tile.rim()
    label = np.arange(outer.size).reshape(tile.shape)
    level, least = height.copy(), {}

    def visit(a, b, new):
        if new:
            label[b] = label[a]
            level[b] = max(level[a], height[b])
        elif label[a] != label[b]:
            pair = (min(label[a], label[b]), max(label[a], label[b]))
            least[pair] = min(least.get(pair, np.inf), max(level[a], level[b]))

    _flood(tile, height, outer, height, visit)
    name = lambda i, j: f"{key[0]}/{i + tile.r0}/{j + tile.c0}"
    cell = lambda k: name(*divmod(int(k), tile.shape[1]))
    rows = [(cell(a), cell(b), float(w)) for (a, b), w in least.items()]
    for i, j in zip(*np.nonzero(outer), strict=True):
        if rim[i, j]:
            rows.append((name(i, j), f"{key[0]}/", float(height[i, j])))
        for k in tile.neighbours(i, j):
            if not tile.own[k] and (i, j) < k:  # the tile before it on the grid tells of the pass
                rows.append((name(i, j), name(*k), float(max(height[i, j], height[k]))))
    return pd.DataFrame(rows, columns=["u", "v", "w"])


def _levels(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    tile = Tile(pdf)
    level = _flood(tile, tile.array("v", np.nan), tile.outer(), tile.array("level", np.inf))
    return tile.frame(key, tile.own, v=tile.array("v", np.nan), level=level)


def _distances(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Steps over cells of the same level, from outlets and from what the tiles around know; ``moved``: an outer cell's became fewer."""
    tile = Tile(pdf)
    level, known = tile.array("level", np.inf), tile.array("d", FAR)
    own, rim = tile.own, tile.rim()
    d = known.copy()
    for i, j in zip(*np.nonzero(own), strict=True):
        if rim[i, j] or any(level[k] < level[i, j] for k in tile.neighbours(i, j)):
            d[i, j] = 0
    heap = [(d[k], *k) for k in zip(*np.nonzero(tile.there & (d < FAR)), strict=True)]
    heapq.heapify(heap)
    while heap:
        n, i, j = heapq.heappop(heap)
        if n > d[i, j]:
            continue
        for a, b in NEAR:
            k = (i + a, j + b)
            if 0 <= k[0] < tile.shape[0] and 0 <= k[1] < tile.shape[1] and own[k] and level[k] == level[i, j] and n + 1 < d[k]:
                d[k] = n + 1
                heapq.heappush(heap, (n + 1, *k))
    moved = tile.outer() & (d < known)
    return tile.frame(key, own, v=tile.array("v", np.nan), level=level, d=d.astype(np.int64), moved=moved)


def _directed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Where each cell drains to, how many of the tile's cells drain through it, and at which cell its water leaves the tile."""
    tile = Tile(pdf)
    level, d, rim = tile.array("level", np.inf), tile.array("d", FAR), tile.rim()
    cells = sorted(zip(*np.nonzero(tile.own), strict=True), key=lambda k: (level[k], d[k]))
    to, n, leaves = {}, dict.fromkeys(cells, 1), {}
    for k in cells:
        if not rim[k]:
            to[k] = min(tile.neighbours(*k), key=lambda x: (level[x], d[x], x))
        leaves[k] = None if rim[k] else k if not tile.own[to[k]] else leaves[to[k]]
    for k in reversed(cells):
        if k in to and tile.own[to[k]]:
            n[to[k]] += n[k]
    place = lambda k, axis: pd.array([-1 if x is None else int(x[axis]) + (tile.c0 if axis else tile.r0) for x in k], dtype="int64")
    r, c = place(cells, 0), place(cells, 1)
    ways, ends = [to.get(k) for k in cells], [leaves[k] for k in cells]
    return pd.DataFrame({"grid": key[0], "r": r, "c": c, "level": [level[k] for k in cells], "d": [int(d[k]) for k in cells], "to_r": place(ways, 0), "to_c": place(ways, 1), "drains": [k in to for k in cells], "n": [n[k] for k in cells], "leaves": [x is not None for x in ends], "leave_r": place(ends, 0), "leave_c": place(ends, 1)})


def _summed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["level", "d"], ascending=False)
    at = {k: i for i, k in enumerate(zip(pdf["r"], pdf["c"], strict=True))}
    n = (1 + pdf["come"].to_numpy()).tolist()
    for i, (drains, k) in enumerate(zip(pdf["drains"], zip(pdf["to_r"], pdf["to_c"], strict=True), strict=True)):
        if drains and k in at:
            n[at[k]] += n[i]
    return pd.DataFrame({"grid": key[0], "r": pdf["r"], "c": pdf["c"], "to_r": pdf["to_r"], "to_c": pdf["to_c"], "cells": n, "level": pdf["level"]})


def drainage(cells: DataFrame, *, size: int = 256) -> DataFrame:
    """(grid, r, c, to_r, to_c, cells, level): where each cell of ``cells`` (grid, r, c, v) drains to (-1 from the rim), the number of cells that drain through it with itself, and its fill level.

    ``size``: rows and columns of a tile; it changes no result. Cells without a value are missing; a cell comes once.
    """
    ship(cells.sparkSession)
    cells = stash(cells.where("v IS NOT NULL").select(F.col("grid").cast("string").alias("grid"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("v").cast("double").alias("v")), "cells")
    tile = ["grid", "tr", "tc"]

    def tiles(df: DataFrame, work, schema: str) -> DataFrame:
        return haloed(df, size).groupBy(*tile).applyInPandas(lambda key, pdf: work(key, pdf) if pdf["own"].any() else pd.DataFrame(columns=[f.split()[0] for f in schema.split(", ")]), schema)

    passes = stash(tiles(cells, _passes, "u string, v string, w double"), "passes")
    order = running(passes.withColumn("id", F.lit(1).cast("long")), ["w", "u", "v"], sums=("id",))
    order = stash(order, "ordered")
    tree = order.join(spanning_forest(order.select("id", "u", "v")), "id", "left_semi")
    walk = tour(tree, root=F.col("a").endswith("/"))
    down = walk.join(walk.select(F.col("id").alias("back"), F.col("pos").alias("up")), "back").where("pos < up").select(F.col("b").alias("node"), F.col("a").alias("to"))
    pair = [F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"), "w"]
    weighed = down.withColumns({"x": F.least("node", "to"), "y": F.greatest("node", "to")}).join(tree.select(*pair), ["x", "y"])
    spilled = follow(weighed.select("node", "to", "w"), tops=("w",)).select("node", F.col("w").alias("level"))
    filled = cells.withColumn("node", _name("grid", "r", "c")).join(spilled, "node", "left").drop("node")
    levels = stash(tiles(filled, _levels, "grid string, r long, c long, v double, level double"), "levels")

    schema = "grid string, r long, c long, v double, level double, d long, moved boolean"
    own = [F.floor(F.col(k) / size).alias(f"t{k}") for k in ("r", "c")]
    known = stash(tiles(levels.withColumn("d", F.lit(FAR)), _distances, schema), "distances")
    while True:
        # tiles that touch a cell whose distance has become less
        due = stash(haloed(known.where("moved"), size).where("NOT own").select(*tile).distinct(), "due")
        if due.isEmpty():
            break
        again = haloed(known, size).join(due, tile, "left_semi").groupBy(*tile).applyInPandas(lambda key, pdf: _distances(key, pdf) if pdf["own"].any() else pd.DataFrame(columns=["grid", "r", "c", "v", "level", "d", "moved"]), schema)
        rest = known.select("grid", "r", "c", "v", "level", "d", F.lit(False).alias("moved"), *own).join(due, tile, "left_anti").drop("tr", "tc")
        known = stash(again.unionByName(rest), "distances")

    flow = stash(tiles(known, _directed, "grid string, r long, c long, level double, d long, to_r long, to_c long, drains boolean, n long, leaves boolean, leave_r long, leave_c long"), "flow")
    exits = flow.where("leaves AND r = leave_r AND c = leave_c").select("grid", _name("grid", "r", "c").alias("node"), F.col("to_r").alias("r"), F.col("to_c").alias("c"), F.col("n").alias("weight"))
    links = exits.join(flow.where("leaves").select("grid", "r", "c", _name("grid", "leave_r", "leave_c").alias("to")), ["grid", "r", "c"]).select("node", "to")
    through = gathered(exits, links).withColumnRenamed("weight", "come")
    come = exits.select("node", "grid", "r", "c").join(through, "node").groupBy("grid", "r", "c").agg(F.sum("come").alias("come"))
    fed = flow.join(come, ["grid", "r", "c"], "left").na.fill(0, ["come"]).select("*", *own)
    return fed.groupBy(*tile).applyInPandas(_summed, "grid string, r long, c long, to_r long, to_c long, cells long, level double")
