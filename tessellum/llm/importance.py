"""Target-distribution importance resampling over hashed word n-grams.

Words met in a worker get whole numbers from a dictionary, and an n-gram is the tuple of its words' numbers. A batch's tuples are
sorted, so each distinct one is rebuilt to bytes and hashed once; its bucket is then joined back to every place where it
stands, and the places are counted by text and bucket. These counts are written as a table, which Spark adds up to
the corpus's counts of every bucket. Gains are a table of as many rows as there are buckets; they are joined back to the texts'
counts, so no text is split or hashed again, and what travels is at most one row a bucket from every task.

The draw adds Gumbel noise to the weights and takes the highest scores, which is sampling without replacement in proportion to
the weights' exponentials. Scores are put in order by ranges, so no task holds more than its share; a row's rank is its
place in its range after the rows of the ranges before.

Defined results: a null or empty text has no words and weight 0; it can't be drawn with fewer words than asked. A null ``doc_id``
counts as '' in the noise and comes after others in ties. Repeated rows are counted, scored and ranked each, equal ones in any order.
An empty table gives no rows, and without target texts every t is 0. Very long texts are batches of their own. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.plans.stages import stash

from .batches import fresh, kept, map_batches, texts_of

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Dictionary:
    """A number for each distinct word, and the bucket of each distinct tuple of numbers met lately."""

    def __init__(self, length: int, buckets: int, keep: int = 400_000):
        self.length, self.buckets, self.keep = length, buckets, keep
        self.release()

    def release(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.met: dict[tuple[int, ...], int] = {}

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts as numbers, and how many words each text has."""
        found = [WORD.findall(x.encode().lower()) for x in texts]  # bytes.lower() changes A-Z alone
        if len(self.words) > self.keep:
            self.release()
        numbers = self.numbers
        for w in set().union(*found):
            if w not in numbers:
                numbers[w] = len(self.words)
                self.words.append(w)
        flat = np.fromiter((i for own in found for i in map(numbers.__getitem__, own)), np.int64, sum(map(len, found)))
        return flat, np.array([len(x) for x in found], np.int64)

    def bucket(self, gram: tuple[int, ...]) -> int:
        got = self.met.get(gram)
        if got is None:
            if len(self.met) >= self.keep:
                self.met.clear()
            got = self.met[gram] = zlib.crc32(b" ".join(map(self.words.__getitem__, gram))) % self.buckets
        return got

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; then for each text and bucket of it the text's place, the bucket and its count."""
        words, n = self.of(texts)
        row = np.repeat(np.arange(len(texts)), n)
        place = np.zeros(0, np.int64)
        gram = np.zeros(len(words), np.int64)
        for size in range(1, self.length + 1):
            whole = np.flatnonzero(row[size - 1 :] == row[: len(row) - size + 1]) if len(row) >= size else np.zeros(0, np.int64)
            # tuples of this size by number: that of the tuple one word shorter and the last word
            longer = gram[whole] * (len(self.words) + 1) + words[whole + size - 1]
            different, first, back = np.unique(longer, return_index=True, return_inverse=True)
            starts = whole[first]
            tuples = zip(*(words[starts + k].tolist() for k in range(size)), strict=True)
            bucket = np.fromiter(map(self.bucket, tuples), np.int64, len(different))
            place = np.concatenate([place, row[whole] * self.buckets + bucket[back]])
            gram = np.zeros(len(words), np.int64)
            gram[whole] = back
        key, times = np.unique(place, return_counts=True)
        return n, key // self.buckets, key % self.buckets, times


def features(docs: DataFrame, length: int = 1, buckets: int = 10_000, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_features, buckets, times of every text: in which buckets its runs of 1 to ``length`` words are, and how often."""

    def make():
        d = kept(f"importance {length} {buckets}", lambda: Dictionary(length, buckets))

        def step(batch):
            n, row, bucket, times = d.counts(batch.column("text").to_pylist())
            edges = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            sums = np.concatenate([[0], np.cumsum(times)])
            return {
                "doc_id": batch.column("doc_id"),
                "n_words": n,
                "n_features": np.diff(sums[edges.to_numpy()]),
                "buckets": pa.ListArray.from_arrays(edges, pa.array(bucket, pa.int32())),
                "times": pa.ListArray.from_arrays(edges, pa.array(times, pa.int64())),
            }

        return step

    return map_batches(texts_of(docs, doc_id=doc_id), make, "doc_id long, n_words long, n_features long, buckets array<int>, times array<long>")


def bucket_counts(held: DataFrame) -> DataFrame:
    """bucket, n over all texts of a ``features`` table; added up in each task before it travels."""
    return held.select(F.explode(F.arrays_zip("buckets", "times")).alias("x")).groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.times").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """bucket, gain for every bucket: a thousandth of the log ratio of the target's smoothed share to the corpus's, floored; ``buckets`` rows."""
    spark = raw.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    sums = [bucket_counts(x).withColumnRenamed("n", n) for x, n in ((raw, "s"), (target, "t"))]
    both = every.join(sums[0], "bucket", "left").join(sums[1], "bucket", "left").fillna(0, ["s", "t"])
    total = stash(both, "bucket_counts")
    whole = total.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    dbl = lambda c, add: (F.col(c) + F.lit(add)).cast("double")
    ratio = dbl("t", 1) * F.lit(float(whole.s + buckets)) / (dbl("s", 1) * F.lit(float(whole.t + buckets)))
    return total.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def weights(held: DataFrame, gain: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features, weight of a ``features`` table: the gains, one number a bucket, meet the counts where these are."""
    table = np.array([r.gain for r in sorted(gain.collect(), key=lambda r: r.bucket)], np.int64)  # one row a bucket, a parameter

    def make():
        def step(batch):
            listed, times = batch.column("buckets"), batch.column("times")
            sums = np.concatenate([[0], np.cumsum(table[listed.flatten().to_numpy()] * times.flatten().to_numpy())])
            edges = np.concatenate([[0], np.cumsum(listed.value_lengths().to_numpy())])
            return {n: batch.column(n) for n in ("doc_id", "n_words", "n_features")} | {"weight": np.diff(sums[edges])}

        return step

    return map_batches(held, make, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: str, doc_id: str = "doc_id"):
    """A thousandth of a Gumbel draw, floored, from the first 32 bits of the digest of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """``rows`` with their place in that order, from 1: ranges are put in order apart, and the rows of the ranges before are added.

    The broadcast table has one row a range, spark.sql.shuffle.partitions at most. Rows that are equal in all of ``order`` may be dealt to several ranges.
    """
    spark = rows.sparkSession
    tie, place, part, before = fresh(rows, "tie", "place", "part", "before")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*order, F.col(tie)]
    # the number holds the range's own number over the place in it, and is written before it is used, for ranges are cut by a sample
    put = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    put = stash(put.withColumn(place, F.monotonically_increasing_id()), "ranked").withColumn(part, F.shiftright(place, 33))
    sizes = sorted((r[0], r[1]) for r in put.groupBy(part).count().collect())
    sums = [0, *accumulate(n for _, n in sizes)]
    offsets = spark.createDataFrame([(p, at) for (p, _), at in zip(sizes, sums, strict=False)], f"{part} long, {before} long")
    return put.join(F.broadcast(offsets), part).withColumn(name, F.col(before) + F.col(place).bitwiseAND((1 << 33) - 1) + 1).drop(tie, place, part, before)


def resampled(docs: DataFrame, target: DataFrame, *, target_id: str = "doc_id", length: int = 1, buckets: int = 10_000, seed: str = "2024", least: int = 20, percent: int = 10) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document: of those with ``least`` words or more, ``percent`` in a hundred are drawn and ranked."""
    held = stash(features(docs, length, buckets), "features")
    gain = gains(held, features(target, length, buckets, target_id), buckets)
    scored = stash(weights(held, gain).withColumn("score", F.col("weight") + noise(seed)), "scored")
    can = scored.where(F.col("n_words") >= least)
    draw = percent * can.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features")]
    drawn = ranked(can, order).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """doc_id, rank of the documents that are drawn."""
    return resampled(docs, target, **how).where("rank IS NOT NULL").select("doc_id", "rank")


def oracle(buckets: int = 10_000, seed: str = "2024", least: int = 20, percent: int = 10) -> str:
    """The same over single words; the checksum goes byte by byte through a table made by its own rule."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
b AS (SELECT {words} AS w FROM benchmark),
bits AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce([n, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS n))),
dw AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY ALL),
bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM b) GROUP BY ALL),
distinct_words AS (SELECT word FROM dw UNION SELECT word FROM bw),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i::INTEGER + 1, 2))::BIGINT)),
    lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % {buckets} AS bucket FROM distinct_words, bits),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::BIGINT AS t FROM bw JOIN hashed USING (word) GROUP BY bucket),
whole AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS sa, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS ta),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sa + {buckets}) / ((s + 1)::DOUBLE * (ta + {buckets}))))::BIGINT AS g FROM s LEFT JOIN t USING (bucket), whole),
weighed AS (SELECT r, sum(n * g)::BIGINT AS weight FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN weighed USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) OVER () AS n FROM scored WHERE n_features >= {least})
SELECT doc_id, n_features, weight, score, CASE WHEN k <= {percent} * n // 100 THEN k END AS rank FROM scored LEFT JOIN placed USING (r)
"""
