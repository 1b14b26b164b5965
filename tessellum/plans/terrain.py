"""Queries of relief, on the smoothed grid of parts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessellum.operators import terrain as T

from .outlines import GRID, grid
from .registry import query


def gradient_sql(of: str, *values: str) -> str:
    """Change by column and row of a table (r, c, ...), one-sided at its rim."""
    each = ", ".join(f"coalesce((e.{v} - w.{v}) / 2, e.{v} - o.{v}, o.{v} - w.{v}) AS {v}_x, coalesce((s.{v} - n.{v}) / 2, s.{v} - o.{v}, o.{v} - n.{v}) AS {v}_y" for v in values)
    sides = " ".join(f"LEFT JOIN {of} {k} ON {k}.r = o.r + {dr} AND {k}.c = o.c + {dc}" for k, dr, dc in (("e", 0, 1), ("w", 0, -1), ("s", 1, 0), ("n", -1, 0)))
    return f"SELECT o.*, {each} FROM {of} o {sides}"


ALT = math.radians(42)
SHADE = " + ".join(f"{w} * ({math.sin(ALT)!r}::DOUBLE * cos(slope) + {math.cos(ALT)!r}::DOUBLE * sin(slope) * cos({math.radians(a)!r}::DOUBLE - aspect))" for a, w in T.LIGHTS)


@query(f"""
WITH {GRID}, g AS ({gradient_sql("grid", "v")}), a AS (SELECT r, c, atan(sqrt(v_x * v_x + v_y * v_y) * 1.6) AS slope, atan2(-v_x, -v_y) AS aspect FROM g WHERE v_x IS NOT NULL AND v_y IS NOT NULL)
SELECT r, c, round(greatest(0, least(1, {SHADE})), 6) AS shade FROM a
""")
def hill_shade(spark, sf_dir):
    return T.hill_shade(grid(spark, sf_dir)).select("r", "c", F.round("shade", 6).alias("shade"))


@query(f"""
WITH {GRID}, g AS ({gradient_sql("grid", "v")}), f AS (SELECT r, c, v_x AS p, v_y AS q FROM g WHERE v_x IS NOT NULL AND v_y IS NOT NULL), h AS ({gradient_sql("f", "p", "q")}), d AS (SELECT *, p * p + q * q AS g2 FROM h)
SELECT r, c, round(degrees(atan(sqrt(g2))), 5) AS slope, CASE WHEN g2 > 1e-9 THEN round(-(p_x * p * p + 2 * p_y * p * q + q_y * q * q) / (g2 * (1 + g2) ** 1.5), 7) END AS profile,
 CASE WHEN g2 > 1e-9 THEN round(-(q_y * p * p - 2 * p_y * p * q + p_x * q * q) / g2 ** 1.5, 5) END AS plan FROM d
""")
def curvatures(spark, sf_dir):
    return T.curvatures(grid(spark, sf_dir)).select("r", "c", F.round("slope", 5).alias("slope"), F.round("profile", 7).alias("profile"), F.round("plan", 5).alias("plan"))
