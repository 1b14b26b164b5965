"""Queries of masks and classes, on the grid of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellum.operators import masks as M

from .outlines import GRID, classes, grid
from .registry import query


@query(f"""
WITH {GRID} SELECT a.r, a.c, round(min(sqrt((a.r - b.r) ** 2 + (a.c - b.c) ** 2)), 6) AS dist, round(least(6.0, min(sqrt((a.r - b.r) ** 2 + (a.c - b.c) ** 2))), 6) AS near FROM grid a, grid b WHERE b.v >= 48 GROUP BY a.r, a.c
""")
def distance_field(spark, sf_dir):
    """Distance of every cell to the nearest high one, whole and cut off."""
    g = grid(spark, sf_dir)
    got = M.distances(g.where("v >= 48"), g)
    return got.select("r", "c", F.round("dist", 6).alias("dist"), F.round(F.least("dist", F.lit(6.0)), 6).alias("near"))


@query(f"""
WITH RECURSIVE {GRID}, m AS (SELECT r, c FROM grid WHERE v <= 32), f AS (SELECT r, c FROM range((SELECT max(r) + 1 FROM m)) a(r), range(20) b(c) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.r = a.r AND m.c = b.c)),
o AS (SELECT r, c FROM f WHERE r IN ((SELECT min(r) FROM m), (SELECT max(r) FROM m)) OR c IN ((SELECT min(c) FROM m), (SELECT max(c) FROM m)) UNION SELECT f.r, f.c FROM o JOIN f ON abs(f.r - o.r) + abs(f.c - o.c) = 1)
SELECT r, c FROM f WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.r = f.r AND o.c = f.c)
""")
def mask_holes(spark, sf_dir):
    """Cells that the low ones close in."""
    return M.holes(grid(spark, sf_dir).where("v <= 32"))


@query(f"""
WITH {GRID}, near AS (SELECT e.r, e.c, k.kind, min((e.r - k.r) ** 2 + (e.c - k.c) ** 2) AS d2 FROM grid e, classes k WHERE e.v % 3 = 0 AND NOT EXISTS (SELECT 1 FROM grid g WHERE g.r = k.r AND g.c = k.c AND g.v % 3 = 0) GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY d2, kind) AS i FROM near WHERE d2 <= 16) SELECT r, c, kind, CAST(d2 AS BIGINT) AS d2 FROM n WHERE i = 1
""")
def grown_classes(spark, sf_dir):
    """Unclassified cells take the nearest class within four cells, the least one on ties."""
    open_cells = grid(spark, sf_dir).where("v % 3 = 0")
    known = classes(spark, sf_dir).join(open_cells.select("r", "c"), ["r", "c"], "left_anti")
    return M.grown(known, open_cells, reach=4.0)


MOST = "SELECT * FROM (SELECT e.r, e.c, k.kind, count(*) AS n, row_number() OVER (PARTITION BY e.r, e.c ORDER BY count(*) DESC, k.kind) AS i FROM {e} e JOIN {k} k ON abs(e.r - k.r) <= {h} AND abs(e.c - k.c) <= {h} GROUP BY e.r, e.c, k.kind) WHERE i = 1 AND n >= {n}"


@query(f"""
WITH {GRID}, e0 AS (SELECT r, c FROM grid WHERE v % 2 = 0), k0 AS (SELECT * FROM classes k WHERE NOT EXISTS (SELECT 1 FROM e0 WHERE e0.r = k.r AND e0.c = k.c)),
n1 AS ({MOST.format(e="e0", k="k0", h=2, n=6)}), k1 AS (SELECT r, c, kind FROM k0 UNION ALL SELECT r, c, kind FROM n1), e1 AS (SELECT r, c FROM e0 EXCEPT SELECT r, c FROM n1),
n2 AS ({MOST.format(e="e1", k="k1", h=2, n=6)}), k2 AS (SELECT r, c, kind FROM k1 UNION ALL SELECT r, c, kind FROM n2), m AS ({MOST.format(e="k2", k="k2", h=1, n=4)})
SELECT k2.r, k2.c, coalesce(m.kind, k2.kind) AS kind FROM k2 LEFT JOIN m ON m.r = k2.r AND m.c = k2.c
""")
def majority_classes(spark, sf_dir):
    """Two rounds of filling by the majority of five by five cells, then that of three by three."""
    open_cells = grid(spark, sf_dir).where("v % 2 = 0")
    known = classes(spark, sf_dir).join(open_cells.select("r", "c"), ["r", "c"], "left_anti")
    return M.smoothed_classes(M.majority_filled(known, open_cells, size=5, least=6, rounds=2), size=3, least=4)
