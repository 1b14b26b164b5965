"""Queries of ordered profiles, on the events of each user."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellum.operators import ordered as O

from .registry import query, table

BY = ["ts", "event_id"]


def micros(at):
    """Microseconds since 1970 of a time of any kind."""
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("""
SELECT event_id, round(sum(value) OVER w, 4) AS cum, min(value) OVER w AS low, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS step
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def running_profile(spark, sf_dir):
    return O.running(events(spark, sf_dir), key="user_id", order=BY, value="value").select("event_id", F.round("cum", 4).alias("cum"), "low", F.round("step", 4).alias("step"))


@query("""
WITH a AS (SELECT event_id, value, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS w FROM events),
m AS (SELECT event_id, value, w, list_aggregate(w, 'median') AS m FROM a), d AS (SELECT *, 1.4826 * list_aggregate(list_transform(w, lambda x: abs(x - m)), 'median') AS mad FROM m)
SELECT event_id, round(CASE WHEN mad > 0 AND abs(value - m) > 3 * mad THEN m ELSE value END, 4) AS filtered FROM d
""")
def hampel(spark, sf_dir):
    return O.hampel(events(spark, sf_dir), key="user_id", order=BY, value="value").select("event_id", F.round("filtered", 4).alias("filtered"))


@query("""
WITH a AS (SELECT user_id, event_id, ts, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(list_aggregate(list_concat(list_concat(list_transform(range(greatest(3 - i, 0)), lambda x: near[1]), near), list_transform(range(greatest(i + 2 - n, 0)), lambda x: near[-1])), 'median'), 4) AS smooth FROM a
""")
def running_median(spark, sf_dir):
    return O.running_median(events(spark, sf_dir), key="user_id", order=BY, value="value", width=5).select("event_id", F.round("smooth", 4).alias("smooth"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f AS (SELECT user_id, i, n, value AS last, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.i, e.n, CASE WHEN abs(e.value - f.last) >= 20 OR e.i = e.n THEN e.value ELSE f.last END,
  f.up + CASE WHEN (abs(e.value - f.last) >= 20 OR e.i = e.n) AND e.value > f.last THEN e.value - f.last ELSE 0 END,
  f.down + CASE WHEN (abs(e.value - f.last) >= 20 OR e.i = e.n) AND e.value < f.last THEN f.last - e.value ELSE 0 END
 FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, round(up, 4) AS up, round(down, 4) AS down FROM f WHERE i = n
""")
def climb_hysteresis(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("o", F.struct(*BY))
    return O.climb(e, key="user_id", order="o", value="value", least=20.0).select("user_id", F.round("up", 4).alias("up"), F.round("down", 4).alias("down"))


@query("""
WITH e AS (SELECT *, epoch_us(ts) AS us FROM events)
SELECT a.event_id, round((SELECT value FROM e b WHERE b.user_id = a.user_id AND b.us >= a.us + 86400000000 ORDER BY b.us LIMIT 1) - a.value, 4) AS change FROM e a
""")
def sliding_grade(spark, sf_dir):
    at = micros("ts")
    return O.reach_change(events(spark, sf_dir), key="user_id", at=at, value="value", reach=86_400_000_000).select("event_id", F.round("change", 4).alias("change"))


@query("""
WITH e AS (SELECT *, epoch_us(ts)::DOUBLE AS x, CASE WHEN event_type <> 'error' THEN value END AS v FROM events),
g AS (SELECT event_id, v, x, last_value(v IGNORE NULLS) OVER p AS v0, last_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER p AS x0,
 first_value(v IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER f AS x1 FROM e
 WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(v, v0 + (v1 - v0) * ((x - x0) / nullif(x1 - x0, 0)), v0, v1), 4) AS filled FROM g
""")
def gap_fill(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("v", F.when(F.col("event_type") != "error", F.col("value"))).withColumn("o", F.struct(*BY))
    return O.fill_gaps(e, key="user_id", order="o", at=micros("ts"), value="v").select("event_id", F.round("filled", 4).alias("filled"))


@query("""
WITH e AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS value, count(*) AS n, min(ts) AS first, max(ts) AS last FROM r GROUP BY user_id, run
""")
def islands(spark, sf_dir):
    return O.islands(events(spark, sf_dir), key="user_id", order=BY, same="event_type")


@query("""
WITH e AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session
""")
def sessions_by_gap(spark, sf_dir):
    s = O.sessions(events(spark, sf_dir), key="user_id", order=BY, at=micros("ts"), gap=1_800_000_000)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
WITH e AS (SELECT user_id, event_id, value >= 20 AS h, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, i, event_id, h AND lead(h) OVER w AND lead(h, 2) OVER w AS ok FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, min_by(event_id, i) AS first FROM s WHERE ok GROUP BY user_id
""")
def first_sustained(spark, sf_dir):
    return O.first_sustained(events(spark, sf_dir), key="user_id", order=BY, holds=F.col("value") >= 20, n=3, keep="event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) WHERE (i - 1) % 10 = 0")
def every_tenth(spark, sf_dir):
    return O.every_kth(events(spark, sf_dir), key="user_id", order=BY, k=10).select("event_id")


@query("""
WITH e AS (SELECT user_id, CAST(epoch_ms(ts) AS DOUBLE) / 3600000 AS a, value AS v FROM events), p AS (SELECT user_id, a AS a0, v AS v0, lead(a) OVER w AS a1, lead(v) OVER w AS v1 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY a)),
g AS (SELECT *, unnest(generate_series(CAST(ceil(a0 / 24) AS BIGINT), CAST(ceil(a1 / 24) - 1 AS BIGINT))) AS k FROM p WHERE a1 > a0)
SELECT user_id, k * 24.0::DOUBLE AS at, round(v0 + (v1 - v0) * (k * 24 - a0) / (a1 - a0), 4) AS value FROM g
""")
def resampled(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", (F.floor((micros("ts") + 500) / 1000).cast("double") / 3600000).alias("a"), F.col("value").alias("v"))  # the nearest millisecond
    return O.resample(e, key="user_id", at="a", value="v", step=24.0).select("user_id", "at", F.round("value", 4).alias("value"))


@query("""
SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts), event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1
""")
def dedupe_first(spark, sf_dir):
    return O.one_per(events(spark, sf_dir), by=["user_id", F.date_trunc("day", "ts"), "event_type"], order=[F.desc("value"), F.col("event_id")]).select("event_id")


@query("""
SELECT l_orderkey, l_partkey, CAST(max_by(l_linenumber, l_linenumber) AS INTEGER) AS l_linenumber, max_by(l_quantity, l_linenumber * 1000 + l_quantity) AS qty FROM lineitem GROUP BY 1, 2
""")
def dedupe_last(spark, sf_dir):
    # the last of a key by an aggregate with partial sums: no sort, and no key gathers its rows in one task
    df = table(spark, sf_dir, "lineitem")
    return df.groupBy("l_orderkey", "l_partkey").agg(F.max("l_linenumber").alias("l_linenumber"), F.max_by("l_quantity", F.col("l_linenumber") * 1000 + F.col("l_quantity")).alias("qty"))


@query("""
SELECT user_id, CAST(ceil((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 21600000000.0) AS BIGINT) AS band, count(*) AS n FROM events GROUP BY 1, 2
""")
def minute_bands(spark, sf_dir):
    start = F.lit("2024-01-01 00:00:00")
    band = F.ceil((micros("ts") - micros(start)) / 21_600_000_000)
    return events(spark, sf_dir).groupBy("user_id", band.alias("band")).agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT user_id, event_id, abs(value - lag(value) OVER w) AS d, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, CASE WHEN d <= 15 THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS site FROM c)
SELECT user_id, CAST(max(n) AS BIGINT) AS longest, count(*) AS sites FROM (SELECT user_id, site, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY user_id
""")
def site_clusters(spark, sf_dir):
    w = O.over("user_id", BY)
    e = events(spark, sf_dir)
    marked = e.withColumn("new", F.when(F.abs(F.col("value") - F.lag("value").over(w)) <= 15, 0).otherwise(1))
    marked = marked.withColumn("site", F.sum("new").over(w.rowsBetween(O.Window.unboundedPreceding, 0)))
    return marked.groupBy("user_id", "site").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"), F.count("*").alias("sites"))
