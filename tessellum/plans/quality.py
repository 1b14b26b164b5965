"""Queries of the data-quality gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellum.functions import text as T
from tessellum.operators import quality as Q

from .registry import query, table


@query("""
SELECT 'duplicate' AS "check", 'appears ' || count(*) || ' times' AS msg, CAST(o_custkey AS VARCHAR) AS "where", 'error' AS severity FROM orders GROUP BY o_custkey HAVING count(*) > 1
UNION ALL SELECT 'status', 'value ' || o_orderstatus, CAST(o_orderkey AS VARCHAR), 'error' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'required', 'no note', CAST(o_orderkey AS VARCHAR), 'error' FROM orders WHERE o_orderkey % 5 = 0 AND o_totalprice < 5000
""")
def register_gate(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("note", F.when(F.col("o_orderkey") % 5 != 0, "n").when(F.col("o_totalprice") < 5000, "  ").otherwise("n"))
    return Q.gate(Q.duplicates(o, "o_custkey"), Q.not_in(o, "o_orderkey", "o_orderstatus", ["F", "O"]), Q.required(o, "o_orderkey", "note"))


@query("""
SELECT 'registry' AS "check", 'not registered' AS msg, CAST(k AS VARCHAR) AS "where", 'error' AS severity FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45) WHERE k NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)
UNION ALL SELECT 'registry', 'unused', CAST(p_partkey AS VARCHAR), 'warning' FROM part WHERE p_size > 5 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)
""")
def registry_both_ways(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k"))
    return Q.both_ways(used, table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("k")), "k")


@query("""
SELECT 'set' AS "check", 'missing' AS msg, CAST(k AS VARCHAR) AS "where", 'error' AS severity FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
UNION ALL SELECT 'set', 'unexpected', CAST(k AS VARCHAR), 'error' FROM (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000 EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)
""")
def set_equality(spark, sf_dir):
    want = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    return Q.set_difference(want, table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")), "k")


@query("""
SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice AS e, sum(l_extendedprice) AS g FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) WHERE g IS NULL OR abs(g - e) > 0.5 * abs(e)
""")
def derived_tolerance(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("g"))
    df = table(spark, sf_dir, "orders").join(sums, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return Q.off_by(df, "o_orderkey", "o_totalprice", "g", 0.5, relative=True).select(F.col("where").cast("long").alias("o_orderkey"))


@query("SELECT CAST(item_id AS VARCHAR) AS item FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))")
def stale_claims(spark, sf_dir):
    claims = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("claim"))
    gone = Q.stale(claims, table(spark, sf_dir, "documents").select("text"), key="item_id", text="claim", exact=False, size=24)
    return gone.select(F.col("where").alias("item"))


@query("SELECT count(*) AS gone FROM benchmark WHERE text NOT IN (SELECT text FROM documents WHERE text IS NOT NULL)")
def stale_exact(spark, sf_dir):
    return Q.stale(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), key="item_id", text="text", exact=True).agg(F.count("*").alias("gone"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9](?:[0-9,.]*[0-9])?')) AS n, CAST(list_sum(list_transform(regexp_extract_all(text, '[0-9](?:[0-9,.]*[0-9])?'), lambda x: length(x))) AS BIGINT) AS digits FROM documents WHERE regexp_matches(text, '[0-9]')")
def number_spans(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    s = Q.number_spans(d, key="doc_id", text="text")
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("hi") - F.col("lo")).alias("digits"))


@query("""
WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '[0-9](?:[0-9,.]*[0-9])?')) - len(regexp_extract_all(text, '@mail[0-9](?:[0-9,.]*[0-9])?')) AS uncovered FROM documents) SELECT * FROM n WHERE uncovered > 0
""")
def coverage_antijoin(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    claims = d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("@mail[0-9](?:[0-9,.]*[0-9])?"), F.lit(0)))).alias("claim"))
    spans = Q.literal_spans(d, claims, key="doc_id", text="text", claim="claim")
    left = Q.uncovered(Q.number_spans(d, key="doc_id", text="text"), spans, key="doc_id")
    return left.groupBy("doc_id").agg(F.count("*").alias("uncovered"))


@query("""SELECT 'status' AS "check", 'error' AS severity, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O')""")
def gate_totals(spark, sf_dir):
    return Q.totals(Q.not_in(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus", ["F", "O"]))
