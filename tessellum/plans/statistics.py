"""Queries of statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellum.operators import statistics as S

from .registry import query, table


@query("""
WITH e AS (SELECT event_type, radians((hour(ts) + minute(ts) / 60.0::DOUBLE) * 15.0::DOUBLE) AS a, value AS w FROM events),
s AS (SELECT event_type, sum(w * cos(a)) AS c, sum(w * sin(a)) AS s, sum(w) AS n FROM e GROUP BY 1)
SELECT event_type, round((((degrees(atan2(s, c)) / 15) % 24) + 24) % 24, 6) AS mean, round(sqrt(c * c + s * s) / n, 6) AS r FROM s
""")
def axial_mean(spark, sf_dir):
    hour = F.hour("ts") + F.minute("ts") / F.lit(60.0)
    got = table(spark, sf_dir, "events").groupBy("event_type").agg(*S.axial_mean(hour, F.col("value"), 24.0))
    return got.select("event_type", F.round("mean", 6).alias("mean"), F.round("r", 6).alias("r"))


@query("""
WITH t AS (SELECT source, (sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) + 1.0::DOUBLE) / (count(*) * 20 + 1) AS p FROM labels JOIN documents USING (doc_id) GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY p, source) AS r, count(*) OVER () AS m FROM t)
SELECT source, round(p, 8) AS p, round(least(1.0::DOUBLE, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 8) AS q FROM r
""")
def bh_qvalues(spark, sf_dir):
    df = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    p = (F.count_if(F.col("quality") == 0) + 1.0) / (F.count("*") * 20 + 1)
    got = S.bh_qvalues(df.groupBy("source").agg(p.alias("p")), p="p", key="source")
    return got.select("source", F.round("p", 8).alias("p"), F.round("q", 8).alias("q"))


@query("""
WITH p AS (SELECT user_id, epoch(ts) / 86400 AS x, value AS y FROM events WHERE event_type = 'purchase')
SELECT a.user_id, round(median((b.y - a.y) / (b.x - a.x)), 5) AS slope FROM p a JOIN p b ON a.user_id = b.user_id AND a.x < b.x GROUP BY 1
""")
def theil_sen(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("x", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 86400)
    return S.theil_sen(e, by="user_id", x="x", y="value").select("user_id", F.round("slope", 5).alias("slope"))


@query("""
WITH s AS (SELECT l_returnflag, covar_pop(l_quantity, l_extendedprice) AS xa, covar_pop(l_quantity, l_tax) AS xb, covar_pop(l_extendedprice, l_tax) AS ab, var_pop(l_quantity) AS vx, var_pop(l_extendedprice) AS va, var_pop(l_tax) AS vb FROM lineitem GROUP BY 1)
SELECT l_returnflag, round((ab - xa * xb / vx) / sqrt((va - xa * xa / vx) * (vb - xb * xb / vx)), 6) AS r FROM s
""")
def detrended_corr(spark, sf_dir):
    return S.detrended_corr(table(spark, sf_dir, "lineitem"), by="l_returnflag", x="l_quantity", a="l_extendedprice", b="l_tax").select("l_returnflag", F.round("r", 6).alias("r"))


@query("SELECT event_type, round(median(value), 4) AS median, round(mad(value), 4) AS mad FROM events GROUP BY event_type")
def median_deviation(spark, sf_dir):
    return S.mad(table(spark, sf_dir, "events"), by="event_type", value="value").select("event_type", F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad"))


@query("""
WITH g AS (SELECT l_suppkey, count(*) AS n, median(l_quantity) AS m, quantile_cont(l_extendedprice, 0.9) AS p FROM lineitem GROUP BY 1)
SELECT l_suppkey, CASE WHEN n >= 8 THEN round(m, 4) END AS median, round(p, 4) AS p90 FROM g
""")
def guarded_median(spark, sf_dir):
    got = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.median("l_quantity").alias("m"), F.percentile("l_extendedprice", 0.9).alias("p"))
    return got.select("l_suppkey", F.when(F.col("n") >= 8, F.round("m", 4)).alias("median"), F.round("p", 4).alias("p90"))


@query("""
WITH b AS (SELECT CASE WHEN c_acctbal >= 5000 THEN 2 WHEN c_acctbal >= 1000 THEN 1 WHEN c_acctbal >= 0 THEN 0 END AS band, c_acctbal FROM customer WHERE c_acctbal < 8000)
SELECT band, count(*) AS n, round(median(c_acctbal), 4) AS median FROM b WHERE band IS NOT NULL GROUP BY band HAVING count(*) >= 5
""")
def distance_bands(spark, sf_dir):
    got = S.band_table(table(spark, sf_dir, "customer"), distance=F.col("c_acctbal"), edges=[0, 1000, 5000, 8000], value="c_acctbal")
    return got.select("band", "n", F.round("median", 4).alias("median"))


@query("""
SELECT round(count(*) FILTER (a AND b) / nullif(count(*) FILTER (a OR b), 0), 8) AS iou, round(count(*) FILTER (a AND b) / nullif(count(*) FILTER (a), 0), 8) AS precision,
 round(count(*) FILTER (a AND b) / nullif(count(*) FILTER (b), 0), 8) AS recall FROM (SELECT l_discount > 0.05 AS a, l_quantity > 20 AS b FROM lineitem)
""")
def mask_overlap(spark, sf_dir):
    got = S.overlap_scores(table(spark, sf_dir, "lineitem"), a=F.col("l_discount") > 0.05, b=F.col("l_quantity") > 20)
    return got.select(*[F.round(c, 8).alias(c) for c in ("iou", "precision", "recall")])


@query("""
WITH d AS (SELECT dayofmonth(ts) - 1 AS i, sum(value) AS x, count(*)::DOUBLE AS y FROM events GROUP BY 1), n AS (SELECT count(*) AS n FROM d),
t AS (SELECT k, avg(a.x * b.y) AS t FROM d a, n, generate_series(0, (SELECT n - 1 FROM n)) g(k) JOIN d b ON b.i = (a.i + k) % n GROUP BY k)
SELECT round((SELECT t FROM t WHERE k = 0), 4) AS observed, round((count(*) FILTER (t >= (SELECT t FROM t WHERE k = 0)) + 1.0::DOUBLE) / (count(*) + 1), 8) AS p FROM t WHERE k > 0
""")
def shift_null(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy((F.dayofmonth("ts") - 1).cast("long").alias("i")).agg(F.sum("value").alias("x"), F.count("*").cast("double").alias("y"))
    return S.shift_null(days, at="i", a="x", b="y", decimals=(2, 0)).select(F.round("observed", 4).alias("observed"), F.round("p", 8).alias("p"))


@query("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1), r AS (SELECT v, row_number() OVER (ORDER BY day) AS i FROM d), n AS (SELECT count(*) AS n FROM r),
b AS (SELECT i - 1 AS b, sum(v) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM r), k AS (SELECT CAST(ceil(n / 5) AS BIGINT) AS places, n - 4 AS m FROM n),
p AS (SELECT id // places AS draw, CAST('0x' || substr(md5('6674:' || id), 1, 12) AS BIGINT) % m AS b FROM k, range(0, 4000 * (SELECT places FROM k)) t(id)), m AS (SELECT draw, sum(s) / (any_value(places) * 5) AS m FROM p JOIN b USING (b), k GROUP BY draw)
SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m
""")
def block_bootstrap(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return S.block_bootstrap(days, value="v", order="day", block=5, draws=4000, seed=6674).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
