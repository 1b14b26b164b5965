"""Queries of slopes and centre lines, on users' events as profiles and on the grid of parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessellum.operators import rasters as R
from tessellum.operators import slopes as S

from .outlines import GRID, classes
from .registry import query, table

PROFILES = """prof AS (SELECT user_id, (row_number() OVER w - 1) * 0.5::DOUBLE AS s, value AS z, event_type = 'error' AS wet, value > 60 AS high, lead(value) OVER w - 2 * value + lag(value) OVER w AS curve FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def profiles(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = F.col("value")
    return table(spark, sf_dir, "events").select("user_id", ((F.row_number().over(w) - 1) * 0.5).alias("s"), v.alias("z"), (F.col("event_type") == "error").alias("wet"), (v > 60).alias("high"), (F.lead(v).over(w) - 2 * v + F.lag(v).over(w)).alias("curve"))


def hinges(source: str) -> str:
    """Every knee's fit from sums over all samples of its profile; the best one of each profile as ``knees``."""
    return f"""he AS (SELECT user_id, min(s) AS a, max(s) AS b FROM {source} GROUP BY user_id), hk AS (SELECT user_id, a + 6 + unnest(range(CAST(ceil((b - a - 12) / 0.5) AS BIGINT))) * 0.5 AS k FROM he WHERE b - 6 > a + 6),
hs AS (SELECT user_id, k, count(*) AS n, sum(least(s - k, 0)) AS u, sum(greatest(s - k, 0)) AS v, sum(least(s - k, 0) ** 2) AS uu, sum(greatest(s - k, 0) ** 2) AS vv, sum(z) AS y, sum(least(s - k, 0) * z) AS uy, sum(greatest(s - k, 0) * z) AS vy FROM hk JOIN {source} USING (user_id) GROUP BY user_id, k),
hh AS (SELECT *, (y - u * uy / uu - v * vy / vv) / (n - u * u / uu - v * v / vv) AS h FROM hs WHERE uu > 0 AND vv > 0),
hr AS (SELECT user_id, k, any_value(h) AS h, any_value((uy - h * u) / uu) AS up, any_value((vy - h * v) / vv) AS down, sum((z - h - (uy - h * u) / uu * least(s - k, 0) - (vy - h * v) / vv * greatest(s - k, 0)) ** 2) AS rss, count(*) AS n FROM hh JOIN {source} USING (user_id) GROUP BY user_id, k),
knees AS (SELECT user_id, k AS knee, sqrt(rss / n) AS rms, up, down FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rss, k) AS i FROM hr) WHERE i = 1)"""


@query(f"WITH {PROFILES}, {hinges('prof')} SELECT user_id, knee, round(rms, 5) AS rms, round(up, 5) AS up, round(down, 5) AS down FROM knees")
def profile_hinges(spark, sf_dir):
    """The knee of each profile and how well two lines fit it."""
    got = S.hinge(profiles(spark, sf_dir), by="user_id", s="s", z="z")
    return got.select("user_id", "knee", *(F.round(c, 5).alias(c) for c in ("rms", "up", "down")))


FEET = f"""{PROFILES}, dry AS (SELECT * FROM prof WHERE NOT wet), long AS (SELECT user_id FROM dry GROUP BY user_id HAVING count(*) > 40), dl AS (SELECT dry.* FROM dry JOIN long USING (user_id)), {hinges('dl')},
base AS (SELECT user_id, max(s + 0.25) FILTER (high) AS mountain, CASE WHEN count(*) FILTER (s >= 20 AND NOT wet) > 10 THEN median(z) FILTER (s >= 20 AND NOT wet) END AS plain FROM prof GROUP BY user_id),
o AS (SELECT prof.*, plain, coalesce(z >= plain + 1 AND NOT wet, false) AS above FROM prof JOIN base USING (user_id)), ru AS (SELECT user_id, max(s) + 0.25 AS level FROM o WHERE NOT EXISTS (SELECT 1 FROM o p WHERE p.user_id = o.user_id AND p.s <= o.s AND NOT p.above) GROUP BY user_id),
be AS (SELECT user_id, s AS bend FROM (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY curve NULLS FIRST, s) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM o WHERE NOT wet AND z BETWEEN plain - 0.5 AND plain + 10) WHERE i = 1 AND n > 5),
four AS (SELECT base.user_id, plain, mountain, level, bend, knee, rms, [x FOR x IN [mountain, level, bend, knee] IF x IS NOT NULL] AS f FROM base LEFT JOIN ru USING (user_id) LEFT JOIN be USING (user_id) LEFT JOIN knees USING (user_id)),
feet AS (SELECT *, list_median(f) AS foot, list_max(f) - list_min(f) AS range, len(f) = 4 AS complete FROM four)"""


@query(f"WITH {FEET} SELECT user_id, round(plain, 5) AS plain, mountain, level, bend, knee, round(foot, 5) AS foot, round(range, 5) AS range, complete FROM feet")
def profile_feet(spark, sf_dir):
    """The foot of each profile by four definitions, and their median."""
    got = S.feet(profiles(spark, sf_dir), by="user_id", ds=0.5)
    return got.select("user_id", F.round("plain", 5).alias("plain"), "mountain", "level", "bend", "knee", F.round("foot", 5).alias("foot"), F.round("range", 5).alias("range"), "complete")


@query(f"""
WITH {FEET}, n AS (SELECT * FROM feet WHERE complete), p AS (SELECT range, unnest([{{'a': 'mountain', 'b': 'level', 'd': abs(mountain - level)}}, {{'a': 'mountain', 'b': 'bend', 'd': abs(mountain - bend)}}, {{'a': 'mountain', 'b': 'knee', 'd': abs(mountain - knee)}},
 {{'a': 'level', 'b': 'bend', 'd': abs(level - bend)}}, {{'a': 'level', 'b': 'knee', 'd': abs(level - knee)}}, {{'a': 'bend', 'b': 'knee', 'd': abs(bend - knee)}}]) AS p FROM n)
SELECT p.a, p.b, count(*) AS n, round(median(p.d), 5) AS median, round(avg(CASE WHEN range <= 8 THEN 1.0::DOUBLE ELSE 0 END), 6) AS close FROM p GROUP BY 1, 2
""")
def feet_agreement(spark, sf_dir):
    """How far the definitions are apart over the profiles that have all four."""
    got = S.agreement(S.feet(profiles(spark, sf_dir), by="user_id", ds=0.5), close=8.0)
    return got.select("a", "b", "n", F.round("median", 5).alias("median"), F.round("close", 6).alias("close"))


@query(f"""
WITH RECURSIVE {GRID}, k AS (SELECT r, c, c - row_number() OVER (PARTITION BY r ORDER BY c) AS g FROM classes WHERE kind = 1), st AS (SELECT r AS row, (min(c) + max(c) + 1) / 2 AS x, max(c) + 1 - min(c) AS size FROM k GROUP BY r, g), n AS (SELECT row, row_number() OVER (ORDER BY row) AS k FROM (SELECT DISTINCT row FROM st)),
pl AS (SELECT * FROM st JOIN n USING (row)), l AS (SELECT a.k, a.x, b.x AS next, row_number() OVER (PARTITION BY a.k, a.x ORDER BY abs(a.x - b.x), b.x) AS i FROM pl a JOIN pl b ON b.k = a.k + 1),
w AS (SELECT k, row, x FROM (SELECT *, row_number() OVER (ORDER BY size DESC, x) AS i FROM pl WHERE k = 1) WHERE i = 1 UNION ALL SELECT pl.k, pl.row, pl.x FROM w JOIN l ON l.k = w.k AND l.x = w.x AND l.i = 1 JOIN pl ON pl.k = w.k + 1 AND pl.x = l.next)
SELECT row, CAST(x AS DOUBLE) AS x FROM w
""")
def class_centre_line(spark, sf_dir):
    """A line from row to row through the middles of one class's runs."""
    runs = R.row_runs(classes(spark, sf_dir).where("kind = 1"), value="kind")
    return S.centre_line(runs.select(F.col("r").alias("row"), F.col("c0").cast("double").alias("a"), F.col("c1").cast("double").alias("b")))
