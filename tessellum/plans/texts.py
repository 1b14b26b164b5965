"""Queries of pages and nested values, and of event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellum.functions import text as T
from tessellum.streaming import events as E

from .registry import query, table


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, length(html) AS n FROM pages")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.title_of(F.col("html")).alias("title"), F.length("html").alias("n"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS text FROM pages")
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query()
def page_inventory(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.html_text_inventory(F.col("html"))).alias("i", "text"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def nested_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT doc_id, len(regexp_extract_all(text, 'th')) AS n, len(regexp_extract_all(text, '[0-9](?:[0-9,.]*[0-9])?')) AS numbers FROM documents")
def literal_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.regexp_count("text", F.lit("th")).cast("long").alias("n"), F.size(T.numbers_in(F.col("text"))).cast("long").alias("numbers"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_windows(spark, sf_dir):
    got = E.windowed(table(spark, sf_dir, "events"), every="1 hour")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT s_suppkey, lower(replace(replace(s_name, '#', ''), ' ', '')) AS k FROM supplier")
def normal_keys(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.normal_key(F.regexp_replace("s_name", "#", "")).alias("k"))


@query("SELECT conv_id, count(*) AS turns, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def conversation_profile(spark, sf_dir):
    roles = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">")
    g = table(spark, sf_dir, "conversations").groupBy("conv_id")
    return g.agg(F.count("*").alias("turns"), (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"), roles.alias("roles"))
