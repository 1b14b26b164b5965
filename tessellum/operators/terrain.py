"""Relief of height grids: gradients, hill shading from several lights, profile and plan curvature."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Direction of each light in degrees from north, and its share.
LIGHTS = ((315, 0.5), (270, 0.2), (0, 0.2), (225, 0.1))


def with_neighbours(cells: DataFrame, names: dict[str, tuple[int, int]], *, values: list[str]) -> DataFrame:
    """``cells`` (r, c, *values) and, for each name, the values (null if missing) of the cell that many rows and columns on, as ``<name>_<value>``.

    Every cell is sent to those that ask for it and they are put together in one grouping.
    """
    asked = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for n, (dr, dc) in {"_o": (0, 0), **names}.items()])
    sent = cells.select("r", "c", *values, F.explode(asked).alias("o")).select((F.col("r") - F.col("o.dr")).alias("r"), (F.col("c") - F.col("o.dc")).alias("c"), F.col("o.n").alias("n"), *values)
    pick = [F.max(F.when(F.col("n") == n, F.col(v))).alias(v if n == "_o" else f"{n}_{v}") for n in ("_o", *names) for v in values]
    return sent.groupBy("r", "c").agg(*pick, F.max((F.col("n") == "_o").cast("int")).alias("_own")).where("_own = 1").drop("_own")


def gradients(cells: DataFrame, *, values: list[str], size: float = 1.0) -> DataFrame:
    """``cells`` (r, c, *values) with ``<value>_x`` and ``<value>_y``: change by column and by row, from both neighbours or, at a rim, from the one there is; null without any."""
    near = with_neighbours(cells, {"_e": (0, 1), "_w": (0, -1), "_s": (1, 0), "_n": (-1, 0)}, values=values)

    def change(v: str, ahead: str, behind: str):
        a, o, b = F.col(f"{ahead}_{v}"), F.col(v), F.col(f"{behind}_{v}")
        return F.coalesce((a - b) / (2 * size), (a - o) / size, (o - b) / size)

    return near.select("r", "c", *values, *(x for v in values for x in (change(v, "_e", "_w").alias(f"{v}_x"), change(v, "_s", "_n").alias(f"{v}_y"))))


def hill_shade(cells: DataFrame, *, lights=LIGHTS, height: float = 42.0, exaggeration: float = 1.6, value: str = "v") -> DataFrame:
    """(r, c, shade): brightness from 0 to 1 of a height grid whose rows run south, lit from several directions at one height above the horizon."""
    g = gradients(cells.select("r", "c", F.col(value).alias("v")), values=["v"])
    gx, gy = F.col("v_x"), -F.col("v_y")
    slope, aspect = F.atan(F.hypot(gx, gy) * exaggeration), F.atan2(-gx, gy)
    alt = math.radians(height)
    shade = sum((w * (math.sin(alt) * F.cos(slope) + math.cos(alt) * F.sin(slope) * F.cos(F.lit(math.radians(a)) - aspect)) for a, w in lights), F.lit(0.0))
    return g.where(F.col("v_x").isNotNull() & F.col("v_y").isNotNull()).select("r", "c", F.greatest(F.lit(0.0), F.least(F.lit(1.0), shade)).alias("shade"))


def curvatures(cells: DataFrame, *, value: str = "v", size: float = 1.0, flat: float = 1e-9) -> DataFrame:
    """(r, c, slope, profile, plan): slope in degrees, and the curvature along the slope and across it, below zero where the ground is hollow; null on flat ground.

    Second derivatives are gradients of the gradients, so a cell looks two cells far.
    """
    first = gradients(cells.select("r", "c", F.col(value).alias("v")), values=["v"], size=size).where("v_x IS NOT NULL AND v_y IS NOT NULL")
    second = gradients(first.select("r", "c", F.col("v_x").alias("p"), F.col("v_y").alias("q")), values=["p", "q"], size=size)
    p, q, r, s, t = F.col("p"), F.col("q"), F.col("p_x"), F.col("p_y"), F.col("q_y")
    g2 = p * p + q * q
    steep = lambda x: F.when(g2 > flat, x)
    profile = -(r * p * p + 2 * s * p * q + t * q * q) / (g2 * F.pow(1 + g2, 1.5))
    plan = -(t * p * p - 2 * s * p * q + r * q * q) / F.pow(g2, 1.5)
    return second.select("r", "c", F.degrees(F.atan(F.sqrt(g2))).alias("slope"), steep(profile).alias("profile"), steep(plan).alias("plan"))
