"""Layers of polygons, grids and mapped features: scanlines, contours, opening, legends, reports and class tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scanline(edges: DataFrame, *, polygon: str, step: float) -> DataFrame:
    """(polygon, row, a, b): the inside of polygons (edges x0, y0, x1, y1) along horizontal lines at (row + 0.5) * step, by the even-odd rule."""
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first, last = F.ceil(low / step - 0.5).cast("long"), (F.ceil(high / step - 0.5) - 1).cast("long")
    rows = edges.withColumn("_f", first).withColumn("_l", last).where("_f <= _l").withColumn("row", F.explode(F.sequence("_f", "_l")))
    y = (F.col("row") + 0.5) * step
    met = rows.select(polygon, "row", (F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))).alias("x"))
    w = Window.partitionBy(polygon, "row").orderBy("x")
    paired = met.withColumn("i", F.row_number().over(w)).withColumn("b", F.lead("x").over(w))
    return paired.where("i % 2 = 1 AND b IS NOT NULL").select(polygon, "row", F.col("x").alias("a"), "b")


def scanned_area(strips: DataFrame, *, polygon: str, step: float) -> DataFrame:
    return strips.groupBy(polygon).agg((F.sum(F.col("b") - F.col("a")) * step).alias("area"))


def scanned_overlap(strips: DataFrame, *, polygon: str, step: float) -> DataFrame:
    """(p, q, area), p < q: what two polygons share, from the strips of each line."""
    one = strips.select("row", F.col(polygon).alias("p"), F.col("a").alias("a0"), F.col("b").alias("a1"))
    two = strips.select("row", F.col(polygon).alias("q"), F.col("a").alias("b0"), F.col("b").alias("b1"))
    shared = F.least("a1", "b1") - F.greatest("a0", "b0")
    return one.join(two, "row").where((F.col("p") < F.col("q")) & (shared > 0)).groupBy("p", "q").agg((F.sum(shared) * step).alias("area"))


def contours(cells: DataFrame, *, levels: list[float]) -> DataFrame:
    """(level, r, c, x0, y0, x1, y1): contour pieces in the squares between four cell centres, where one crosses from side to side; saddles give two."""
    near = {"a": (0, 0), "b": (0, 1), "d": (1, 1), "e": (1, 0)}
    sent = cells.select("r", "c", "v", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for n, (dr, dc) in near.items()])).alias("o"))
    sent = sent.select((F.col("r") - F.col("o.dr")).alias("r"), (F.col("c") - F.col("o.dc")).alias("c"), F.col("o.n").alias("n"), "v")
    square = sent.groupBy("r", "c").agg(*[F.max(F.when(F.col("n") == n, F.col("v"))).alias(n) for n in near], F.count("*").alias("k")).where("k = 4")
    at = square.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    level = F.col("level")
    side = lambda p, q, x, y: F.when((F.col(p) < level) != (F.col(q) < level), F.struct(x.alias("x"), y.alias("y")))
    part = lambda p, q: (level - F.col(p)) / (F.col(q) - F.col(p))
    r, c = F.col("r").cast("double"), F.col("c").cast("double")
    # top, right, bottom, left: crossings in the order around the square
    sides = F.array_compact(F.array(side("a", "b", c + part("a", "b"), r), side("b", "d", c + 1, r + part("b", "d")), side("e", "d", c + part("e", "d"), r + 1), side("a", "e", c, r + part("a", "e"))))
    each = at.withColumn("s", sides).where(F.size("s") >= 2)
    two = F.when(F.size("s") == 4, F.array(F.slice("s", 1, 2), F.slice("s", 3, 2))).otherwise(F.array(F.slice("s", 1, 2)))
    got = each.select("level", "r", "c", F.explode(two).alias("p"))
    return got.select("level", "r", "c", *[F.col("p")[i][k].alias(f"{k}{i}") for i in (0, 1) for k in ("x", "y")])


def _around(mask: DataFrame, *, keep_all: bool) -> DataFrame:
    """Cells all of whose nine (keep_all), or any of whose nine, are in the mask (r, c)."""
    step = F.sequence(F.lit(-1), F.lit(1))
    spread = mask.select("r", "c").withColumn("a", F.explode(step)).withColumn("b", F.explode(step)).select((F.col("r") + F.col("a")).alias("r"), (F.col("c") + F.col("b")).alias("c"))
    n = spread.groupBy("r", "c").agg(F.count("*").alias("n"))
    return n.where("n = 9").select("r", "c") if keep_all else n.select("r", "c")


def opened(mask: DataFrame) -> DataFrame:
    """The mask (r, c) without what is narrower than three cells: eroded, then dilated."""
    return _around(_around(mask.distinct(), keep_all=True), keep_all=False)


def seeded(mask: DataFrame, seeds: DataFrame) -> DataFrame:
    """The connected parts (by sides) of the mask that hold a seed (r, c)."""
    from .components import components

    code = (F.col("r") * F.lit(1 << 31) + F.col("c")).alias("u")
    cells = mask.select("r", "c", code).distinct()
    sides = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0))])
    beside = cells.select("u", F.col("r").alias("r0"), F.col("c").alias("c0"), F.explode(sides).alias("o")).select("u", (F.col("r0") + F.col("o.a")).alias("r"), (F.col("c0") + F.col("o.b")).alias("c"))
    edges = beside.join(cells.select("r", "c", F.col("u").alias("v")), ["r", "c"]).select("u", "v")
    member = components(edges, "u", "v")
    named = cells.join(member, cells.u == member.node, "left").select("r", "c", F.coalesce("component", "u").alias("part"))
    good = named.join(seeds.select("r", "c"), ["r", "c"], "left_semi").select("part").distinct()
    return named.join(good, "part", "left_semi").select("r", "c")


def legend_class(pixels: DataFrame, legend: DataFrame, *, pid: str, name: str, reach: float = 22.0) -> DataFrame:
    """(pid, name): the legend's nearest colour (red, green, blue) within reach, the first name on ties, else null. A legend has a thousand rows at most."""
    l = legend.select(F.col(name).alias("_n"), *[F.col(c).alias(f"_{c}") for c in ("red", "green", "blue")])
    d = F.sqrt(sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in ("red", "green", "blue")), F.lit(0.0)))
    if l.count() > 1000:
        raise ValueError("a legend has a thousand rows at most")
    met = pixels.select(pid, "red", "green", "blue").join(F.broadcast(l), F.lit(True))
    best = met.groupBy(pid).agg(F.min(F.struct(d.alias("d"), "_n")).alias("m"))
    return best.select(pid, F.when(F.col("m.d") <= reach, F.col("m._n")).alias(name))


def curvature(cells: DataFrame, *, value: str = "v") -> DataFrame:
    """(r, c, relief, bend): greatest less least of the nine cells, and the second differences along rows and columns added; whole neighbourhoods only."""
    step = F.sequence(F.lit(-1), F.lit(1))
    sent = cells.select("r", "c", F.col(value).alias("v")).withColumn("a", F.explode(step)).withColumn("b", F.explode(step))
    at = sent.select((F.col("r") + F.col("a")).alias("r"), (F.col("c") + F.col("b")).alias("c"), "v", (F.abs("a") + F.abs("b")).alias("m"))
    four = F.sum(F.when(F.col("m") == 1, F.col("v")).when(F.col("m") == 0, -4 * F.col("v")))
    got = at.groupBy("r", "c").agg(F.count("*").alias("n"), (F.max("v") - F.min("v")).alias("relief"), four.alias("bend"))
    return got.where("n = 9").select("r", "c", "relief", "bend")


def share_report(parts: DataFrame, *, outer: str, inner: str, area: str, whole: str, least: float = 0.0) -> DataFrame:
    """(outer, inner, area, percent, percent_inner, place): areas by inner within outer name, above the least, largest first; of all, and of the inner's whole."""
    g = parts.groupBy(outer, inner).agg(F.sum(area).alias("area"), F.max(whole).alias("_w"))
    total = g.agg(F.sum("area").alias("_t"))
    kept = g.crossJoin(F.broadcast(total)).where(F.col("area") > least)
    place = F.row_number().over(Window.partitionBy(outer).orderBy(F.desc("area"), inner))
    return kept.select(outer, inner, "area", (100 * F.col("area") / F.col("_t")).alias("percent"), (100 * F.col("area") / F.col("_w")).alias("percent_inner"), place.alias("place"))


def first_ref(refs: Column) -> Column:
    """The first of a list of road numbers divided by semicolons, wide ones too; null without one."""
    return F.nullif(F.trim(F.split(F.translate(refs, "；", ";"), ";")[0]), F.lit(""))


def kept_tags(tags: Column, names: list[str]) -> Column:
    return F.map_filter(tags, lambda k, v: k.isin(*names) & v.isNotNull())


def first_in_neighbourhood(points: DataFrame, *, pid: str, size: float) -> DataFrame:
    """Points (pid, x, y) without a point of a smaller id in their cell or the eight around it."""
    at = points.withColumn("_r", F.floor(F.col("y") / size)).withColumn("_c", F.floor(F.col("x") / size))
    step = F.sequence(F.lit(-1), F.lit(1))
    least = at.groupBy("_r", "_c").agg(F.min(pid).alias("_m"))
    near = least.withColumn("a", F.explode(step)).withColumn("b", F.explode(step)).groupBy((F.col("_r") + F.col("a")).alias("_r"), (F.col("_c") + F.col("b")).alias("_c")).agg(F.min("_m").alias("_m"))
    return at.join(near, ["_r", "_c"]).where(F.col(pid) == F.col("_m")).select(*points.columns)


def _box(listed) -> tuple[float, float] | None:
    """(long side, direction of it in degrees) of the smallest rectangle around points, by the directions of the hull's edges."""
    pts = sorted({(p["x"], p["y"]) for p in listed})
    if len(pts) < 2:
        return None

    def half(points) -> list:
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    hull = half(pts) + half(reversed(pts))
    best = None
    for (x0, y0), (x1, y1) in zip(hull, hull[1:] + hull[:1], strict=True):
        n = math.hypot(x1 - x0, y1 - y0)
        if not n:
            continue
        ux, uy = (x1 - x0) / n, (y1 - y0) / n
        along, across = [x * ux + y * uy for x, y in hull], [y * ux - x * uy for x, y in hull]
        a, b = max(along) - min(along), max(across) - min(across)
        turn = math.degrees(math.atan2(uy, ux)) + (90 if b > a else 0)
        got = (round(a * b, 9), max(a, b), min(a, b), turn % 180)
        best = got if best is None else min(best, got)
    return best[1], best[2], best[3]


def smallest_box(points: Column) -> Column:
    """(long, short, direction) of the smallest rectangle around an array of (x, y)."""

    @F.pandas_udf("long double, short double, direction double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            rows = [_box(x) if x is not None else None for x in s]
            yield pd.DataFrame([r or (None, None, None) for r in rows], columns=["long", "short", "direction"], dtype="float64")

    return run(points)


def ramp(value: Column, stops: list[tuple[float, float]]) -> Column:
    """Piecewise linear between the stops (at, value), and the end's value beyond them."""
    out = F.lit(float(stops[-1][1]))
    for (a, v), (b, w) in reversed(list(zip(stops, stops[1:], strict=False))):
        out = F.when(value < b, v + (w - v) * (value - a) / (b - a)).otherwise(out)
    return F.when(value <= stops[0][0], F.lit(float(stops[0][1]))).otherwise(out)
