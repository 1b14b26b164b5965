"""Queries of exposure analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellum.operators import exposure as X

from .registry import query, table


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


@query("""
SELECT l_returnflag, CAST(coalesce(sum(l_quantity) FILTER (l_discount >= 0.05), 0) AS DOUBLE) AS qty_high, CAST(coalesce(sum(l_quantity) FILTER (l_discount < 0.05 OR l_tax = 0), 0) AS DOUBLE) AS qty_other,
  CAST(coalesce(sum(1) FILTER (l_discount >= 0.05), 0) AS BIGINT) AS n_high, CAST(coalesce(sum(1) FILTER (l_discount < 0.05 OR l_tax = 0), 0) AS BIGINT) AS n_other FROM lineitem GROUP BY l_returnflag
""")
def mask_aggregate(spark, sf_dir):
    masks = {"high": F.col("l_discount") >= 0.05, "other": (F.col("l_discount") < 0.05) | (F.col("l_tax") == 0)}
    return lines(spark, sf_dir).groupBy("l_returnflag").agg(*X.mask_sums({"qty": F.col("l_quantity"), "n": F.lit(1).cast("long")}, masks))


@query("""
WITH t AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_quantity >= 40 THEN 3 WHEN l_quantity >= 25 THEN 2 WHEN l_quantity >= 10 THEN 1 ELSE 0 END AS tier, l_quantity FROM lineitem)
SELECT l_returnflag, l_linestatus, CAST(tier AS VARCHAR) AS tier, sum(l_quantity) AS qty, count(*) AS n FROM t GROUP BY 1, 2, 3
UNION ALL SELECT l_returnflag, l_linestatus, 'any', sum(l_quantity), count(*) FROM t WHERE tier > 0 GROUP BY 1, 2
""")
def tier_cube(spark, sf_dir):
    df = lines(spark, sf_dir).withColumn("tier", X.tier_of(F.col("l_quantity"), [10, 25, 40]))
    return X.tier_cube(df, by=["l_returnflag", "l_linestatus"], tier="tier", measures={"qty": F.sum("l_quantity"), "n": F.count("*")})


@query("""
SELECT g.f AS flag, g.d AS days, g.m AS slack, CAST(sum(CASE WHEN date_diff('day', o_orderdate, l_shipdate) - g.d - g.m < 0 THEN 1 ELSE 0 END) AS BIGINT) AS failing,
  sum(CASE WHEN date_diff('day', o_orderdate, l_shipdate) - g.d - g.m < 0 THEN l_quantity ELSE 0 END) AS qty
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN (SELECT * FROM (VALUES ('A'), ('N'), ('R')) a(f), (VALUES (30), (60)) b(d), (VALUES (0), (5), (10)) c(m)) g ON l_returnflag = g.f GROUP BY 1, 2, 3
""")
def scenario_grid(spark, sf_dir):
    grid = X.scenario_grid(spark, flag=["A", "N", "R"], days=[30, 60], slack=[0, 5, 10])
    late = F.col("delay") - F.col("days") - F.col("slack") < 0
    # lines are counted once for each flag and delay; the scenarios meet those few rows only
    joined = lines(spark, sf_dir).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    margins = joined.groupBy("l_returnflag", F.datediff("l_shipdate", "o_orderdate").alias("delay")).agg(F.count("*").alias("k"), F.sum("l_quantity").alias("q"))
    out = margins.join(grid, F.col("l_returnflag") == F.col("flag")).groupBy("flag", "days", "slack")
    return out.agg(F.sum(F.when(late, F.col("k")).otherwise(0)).alias("failing"), F.sum(F.when(late, F.col("q")).otherwise(0.0)).alias("qty"))


@query("""
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90,
 count(*) FILTER (l_quantity < 3) AS under3, count(*) FILTER (l_quantity < 5) AS under5, count(*) FILTER (l_quantity < 10) AS under10 FROM lineitem GROUP BY 1
""")
def group_quantiles(spark, sf_dir):
    p = F.percentile("l_extendedprice", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    got = lines(spark, sf_dir).groupBy("l_returnflag").agg(p.alias("p"), *[F.count_if(F.col("l_quantity") < k).alias(f"under{k}") for k in (3, 5, 10)])
    return got.select("l_returnflag", *[F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p10", "p50", "p90"))], "under3", "under5", "under10")


@query("SELECT l_suppkey, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1 ORDER BY sum(l_quantity) DESC, l_suppkey LIMIT 15")
def top_loaded(spark, sf_dir):
    return X.top_weighted(lines(spark, sf_dir), by="l_suppkey", weight=F.col("l_quantity"), limit=15).select("l_suppkey", F.round("total", 2).alias("total"))


@query("""
SELECT c_mktsegment, round(sum(date_diff('day', o_orderdate, l_shipdate) * l_extendedprice) / nullif(sum(l_extendedprice), 0), 6) AS mean_delay,
 count(*) FILTER (date_diff('day', o_orderdate, l_shipdate) > 30) AS over30, count(*) FILTER (date_diff('day', o_orderdate, l_shipdate) > 60) AS over60
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1
""")
def weighted_mean_delay(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    delay = F.datediff("l_shipdate", "o_orderdate")
    df = lines(spark, sf_dir).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return df.groupBy("c_mktsegment").agg(F.round(X.weighted_mean(delay, F.col("l_extendedprice")), 6).alias("mean_delay"), F.count_if(delay > 30).alias("over30"), F.count_if(delay > 60).alias("over60"))


@query("""
SELECT c_custkey, round(t.total * greatest(c_acctbal, 0) / nullif(sum(greatest(c_acctbal, 0)) OVER (PARTITION BY c_nationkey), 0), 6) AS allocated
FROM customer JOIN (SELECT s_nationkey, sum(s_acctbal) AS total FROM supplier GROUP BY 1) t ON s_nationkey = c_nationkey
""")
def allocate_suppressed(spark, sf_dir):
    totals = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.sum("s_acctbal").alias("total"))
    weights = table(spark, sf_dir, "customer").withColumn("w", F.greatest("c_acctbal", F.lit(0.0)))
    sums = weights.groupBy("c_nationkey").agg(F.sum("w").alias("ws"))  # sums first: a nation's customers never stand in one task
    got = weights.join(totals.join(sums, "c_nationkey"), "c_nationkey")
    return got.select("c_custkey", F.round(F.col("total") * F.col("w") / F.nullif(F.col("ws"), F.lit(0.0)), 6).alias("allocated"))


@query("""
SELECT coalesce(CASE WHEN n % 4 = 3 THEN n - 3 END, n) AS n_nationkey, CAST(sum(k) AS BIGINT) AS customers, coalesce(string_agg(CASE WHEN n % 4 = 3 THEN n_name END, ';' ORDER BY n_name), '') AS merged FROM (
 SELECT n_nationkey AS n, n_name, count(c_custkey) AS k FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1
""")
def merge_hidden(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    n = table(spark, sf_dir, "nation").join(counts, F.col("c_nationkey") == F.col("n_nationkey"), "left").withColumn("customers", F.coalesce("customers", F.lit(0)))
    n = n.withColumn("receiver", F.when(F.col("n_nationkey") % 4 == 3, F.col("n_nationkey") - 3))
    return X.merge_hidden(n, key="n_nationkey", receiver="receiver", values=["customers"], label="n_name")


def _ipf_sql(rounds: int = 5) -> str:
    ctes = ["c0 AS (SELECT c_nationkey AS a, c_mktsegment AS b, CAST(count(*) AS DOUBLE) AS v FROM customer GROUP BY 1, 2)", "ma AS (SELECT a, CAST(1000 + a AS DOUBLE) AS t FROM (SELECT DISTINCT a FROM c0))", "mb AS (SELECT b, (SELECT sum(t) FROM ma) / (SELECT count(DISTINCT b) FROM c0) AS t FROM (SELECT DISTINCT b FROM c0))"]
    for i in range(rounds):
        ctes.append(f"x{i} AS (SELECT a, b, v * t / sum(v) OVER (PARTITION BY a) AS v FROM c{i} JOIN ma USING (a))")
        ctes.append(f"c{i + 1} AS (SELECT a, b, v * t / sum(v) OVER (PARTITION BY b) AS v FROM x{i} JOIN mb USING (b))")
    return "WITH " + ", ".join(ctes) + f" SELECT a, b, round(v, 4) AS v FROM c{rounds}"


@query(_ipf_sql())
def proportional_fit(spark, sf_dir):
    cells = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("a"), F.col("c_mktsegment").alias("b")).agg(F.count("*").alias("v"))
    a = cells.select("a").distinct().withColumn("t", (F.col("a") + 1000).cast("double"))
    whole, k = a.agg(F.sum("t")).first()[0], cells.select("b").distinct().count()
    b = cells.select("b").distinct().withColumn("t", F.lit(whole / k))
    return X.proportional_fit(cells, [("a", a, "t"), ("b", b, "t")], rounds=5, tolerance=0.0).select("a", "b", F.round("v", 4).alias("v"))


@query("""
WITH v AS (SELECT o_custkey, l_linenumber, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY w DESC, l_linenumber) AS k, sum(w) OVER (PARTITION BY o_custkey) AS s FROM v)
SELECT o_custkey, CASE WHEN w / s >= 0.3 THEN l_linenumber END AS l_linenumber, round(w / s, 6) AS share FROM r WHERE k = 1
""")
def majority_code(spark, sf_dir):
    df = lines(spark, sf_dir).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    got = X.majority(df, by="o_custkey", code="l_linenumber", weight=F.col("l_quantity"), least_share=0.3)
    return got.select("o_custkey", "l_linenumber", F.round("share", 6).alias("share"))


@query("""
SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o, count(DISTINCT l_suppkey) AS suppliers,
 min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY 1
""")
def pivot_counts(spark, sf_dir):
    df = lines(spark, sf_dir)
    wide = df.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))
    rest = df.groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))
    return wide.join(rest, "l_returnflag").select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"), "suppliers", "least", "most")


@query("""
WITH t AS (SELECT l_returnflag AS f, CASE WHEN l_quantity >= 25 THEN 'deep' ELSE 'shallow' END AS d, l_extendedprice AS p FROM lineitem)
SELECT f, d, round(sum(p), 2) AS people, round(100.0 * sum(p) / nullif(sum(sum(p)) OVER (PARTITION BY f), 0), 2) AS of_group, round(100.0 * sum(p) / nullif(sum(sum(p)) OVER (), 0), 2) AS of_all FROM t GROUP BY f, d
""")
def tier_shares(spark, sf_dir):
    from pyspark.sql import Window

    tier = F.when(F.col("l_quantity") >= 25, "deep").otherwise("shallow")
    cells = lines(spark, sf_dir).groupBy(F.col("l_returnflag").alias("f"), tier.alias("d")).agg(F.sum("l_extendedprice").alias("p"))
    whole = cells.agg(F.sum("p").alias("all"))  # one row
    got = cells.withColumn("own", F.sum("p").over(Window.partitionBy("f"))).crossJoin(F.broadcast(whole))
    return got.select("f", "d", F.round("p", 2).alias("people"), X.share_of(F.col("p"), F.col("own"), 2).alias("of_group"), X.share_of(F.col("p"), F.col("all"), 2).alias("of_all"))


@query("""
WITH b AS (SELECT l_returnflag, l_extendedprice AS p, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS day FROM lineitem)
SELECT l_returnflag, round(100.0 * coalesce(sum(p) FILTER (day <= 200), 0) / sum(p), 4) AS by200, round(100.0 * coalesce(sum(p) FILTER (day <= 1000), 0) / sum(p), 4) AS by1000 FROM b GROUP BY 1
""")
def cumulative_share(spark, sf_dir):
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date"))
    sums = [F.round(100 * F.coalesce(F.sum(F.when(day <= k, F.col("l_extendedprice"))), F.lit(0.0)) / F.sum("l_extendedprice"), 4).alias(f"by{k}") for k in (200, 1000)]
    return lines(spark, sf_dir).groupBy("l_returnflag").agg(*sums)


@query("""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l_quantity < 2 THEN 'small' WHEN l_discount > 0.08 THEN 'discount' WHEN l_returnflag = 'R' THEN 'returned' ELSE 'ok' END AS reason FROM lineitem) GROUP BY 1
""")
def reason_counts(spark, sf_dir):
    from tessellum.functions.rules import first_rule

    reason = first_rule([(F.col("l_quantity") < 2, "small"), (F.col("l_discount") > 0.08, "discount"), (F.col("l_returnflag") == "R", "returned")], "ok")
    return lines(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""
SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'first' WHEN b THEN 'second' ELSE 'dry' END AS kind, count(*) AS n FROM (SELECT l_discount > 0.05 AS a, l_tax > 0.04 AS b FROM lineitem) GROUP BY 1
""")
def four_way_split(spark, sf_dir):
    from tessellum.functions.rules import four_way

    return lines(spark, sf_dir).groupBy(four_way(F.col("l_discount") > 0.05, F.col("l_tax") > 0.04, "first", "second").alias("kind")).agg(F.count("*").alias("n"))


@query("""
SELECT c_nationkey, CAST(bit_or(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END | CASE WHEN c_acctbal > 9900 THEN 2 ELSE 0 END | CASE WHEN c_mktsegment = 'BUILDING' THEN 4 ELSE 0 END) AS INTEGER) AS kinds,
 bool_or(c_acctbal < 0 AND c_mktsegment = 'BUILDING') AS any_both FROM customer GROUP BY 1
""")
def flag_union(spark, sf_dir):
    flag = lambda c, k: F.when(c, k).otherwise(0)
    low, high, kind = F.col("c_acctbal") < 0, F.col("c_acctbal") > 9900, F.col("c_mktsegment") == "BUILDING"
    bits = flag(low, 1).bitwiseOR(flag(high, 2)).bitwiseOR(flag(kind, 4))
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.bit_or(bits).alias("kinds"), F.bool_or(low & kind).alias("any_both"))
