"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

Items are partitioned by their number of word shingles, in powers of two. A partition's items are sketched
by the shingles of least hash: of n shingles, a text that contains at least t * n misses at most
n - ceil(t * n), so it has one of the n - ceil(t * n) + 1 least ones; each partition takes that number for
its upper bound. A sketch of a long document would not show a short item, so documents are not sketched:
all their shingles meet the sketches, and documents with too few shingles for a partition are left out.
Only the documents that meet a sketch are read again: for these candidates containment is counted
exactly, shingle by shingle as text, against the items whose sketch they met.

Defined results: words are lower-cased runs of characters other than space and U+0009 to U+000D; items and
texts of fewer words than a shingle have none, and so no pair; null counts as empty. Shingles count once per
item, and a long text is cut into shingles whole. Repeated rows give one pair; a null doc_id or item_id is kept
as such; an empty table gives no pairs; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.plans.stages import stash

from .batches import fresh
from .substring_dedup import LAST, id_of, keyed

#: Rows (shingles of the items, candidates, documents that hold items) up to which a table is broadcast; beyond, joins are shuffled.
BROADCAST_ROWS = 500_000
SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES), "")


def shingles(df: DataFrame, keep: list[str], size: int) -> DataFrame:
    """``keep``, n_shingles (repeats included), h and the shingle's words w1, w2, ..."""
    names = [f"w{i}" for i in range(1, size + 1)]
    listed = df.select(*keep, words(F.col("text")).alias("_w")).where(F.size("_w") >= size).withColumn("n_shingles", F.size("_w") - size + 1)
    side_by_side = F.arrays_zip(*[F.slice("_w", i, F.col("n_shingles")).alias(n) for i, n in enumerate(names, 1)])
    return listed.select(*keep, "n_shingles", F.inline(side_by_side)).withColumn("h", F.xxhash64(*names))


def sketched(items: DataFrame, threshold: float, size: int) -> DataFrame:
    """(item_id, n_item, need, h, shingle, sketch): distinct shingles; need = ceil(threshold * n); sketch: whether it is in the partition's sketch."""
    names = [f"w{i}" for i in range(1, size + 1)]
    each = shingles(items, ["item_id"], size).select("item_id", "h", F.concat_ws(" ", *names).alias("shingle")).distinct()
    own = Window.partitionBy("item_id")
    each = each.withColumn("n_item", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("h", "shingle")))
    least = lambda n: F.ceil(F.round(F.lit(threshold) * n, 9))
    upper = F.pow(F.lit(2), F.ceil(F.log2("n_item"))).cast("long")
    return each.select("item_id", "n_item", least(F.col("n_item")).alias("need"), "h", "shingle", (F.col("place") <= upper - least(upper) + 1).alias("sketch"))


def few(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table, to be broadcast if it is counted to have few rows."""
    table = stash(df, name)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def candidates(texts: DataFrame, asked: DataFrame, size: int = 5) -> DataFrame:
    """(did, th, item_id): the texts that have a shingle of an item's sketch, by its hash."""
    sketches = few(asked.where("sketch").select("h", "item_id", "need"), "sketches")
    each = shingles(texts, ["did", "th"], size)
    return each.join(sketches, (each.h == sketches.h) & (each.n_shingles >= sketches.need)).select("did", "th", "item_id").distinct()


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """(did, th, item_id, n_item, n_common): the items of whose distinct shingles a text contains at least the threshold."""
    asked = few(sketched(items, threshold, size), "items")
    texts = keyed(docs)
    met = few(candidates(texts, asked, size).groupBy("did", "th").agg(F.collect_set(F.struct("item_id")).alias("met")), "candidates")
    each = shingles(texts.join(met, ["did", "th"]), ["did", "th", "met"], size)
    same = F.concat_ws(" ", *[each[f"w{i}"] for i in range(1, size + 1)]) == asked["shingle"]
    own = F.exists(each["met"], lambda x: x["item_id"].eqNullSafe(asked["item_id"]))
    hits = each.join(asked, (each.h == asked.h) & same & own).select("did", "th", "item_id", "n_item", "need", "shingle")
    common = hits.distinct().groupBy("did", "th", "item_id", "n_item", "need").agg(F.count("*").alias("n_common"))
    return common.where("n_common >= need").select("did", "th", "item_id", "n_item", "n_common")


def pairs(docs: DataFrame, items: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """doc_id, item_id, n_item, n_common, containment."""
    got = contained(docs, items, threshold, size)
    return got.select(id_of(), "item_id", "n_item", "n_common", (F.col("n_common") / F.col("n_item")).alias("containment")).distinct()


def without_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """The documents that contain no item."""
    did, th = fresh(docs, "did", "th")
    hit = few(contained(docs, items, threshold, size).select(F.col("did").alias(did), F.col("th").alias(th)).distinct(), "hit")
    named = docs.withColumn(did, F.coalesce("doc_id", F.lit(LAST))).withColumn(th, F.xxhash64(F.coalesce("text", F.lit(""))))
    return named.join(hit, [did, th], "left_anti").select(*docs.columns)


def oracle(threshold: float = 0.8, size: int = 5) -> str:
    """The same pairs in DuckDB SQL, by comparing every shingle."""
    return f"""
WITH item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
item_shingles AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + {size - 1}], ' ') AS shingle
  FROM (SELECT item_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM item_words WHERE len(w) >= {size})),
sizes AS (SELECT item_id, count(*) AS n_item FROM item_shingles GROUP BY item_id),
doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
doc_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + {size - 1}], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM doc_words WHERE len(w) >= {size})),
common AS (SELECT doc_id, item_id, count(*) AS n_common FROM doc_shingles JOIN item_shingles USING (shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_common, n_common / n_item AS containment
FROM common JOIN sizes USING (item_id) WHERE n_common >= ceil(round({threshold} * n_item, 9))
""".strip()
