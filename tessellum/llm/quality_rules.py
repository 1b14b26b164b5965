"""Quality rules: counts with fixed limits, then a hashed n-gram log-likelihood ratio.

Byte n-grams are hashed into ``2 ** bits`` buckets. Two multinomials over the buckets are counted: one of the whole
raw corpus, every text, and one of trusted texts, which are the rows labelled 1, at most ``most_trusted`` of them,
those of least hash of the doc_id. A text's verdict is its mean log ratio per n-gram against one fixed
threshold. The table holds whole numbers (``UNIT`` to one nat), so sums don't depend on their order and every text
is judged alike on every run.

What comes to the driver is one row a bucket, whatever the corpus.

Defined results: a null or empty text has no words and fails the base rules; a text too short for an n-gram has
ratio 0; without a trusted text all ratios are 0; repeated rows are judged each; a null doc_id stays null; an empty
table gives no rows; a very long text is counted whole, its n-grams in pieces; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import bounded_batches, map_batches, pieces, texts_of
from .text_stats import Stats
from .words import U, flat

GRAM, BITS, UNIT = 4, 16, 1 << 12
STEP = 1 << 20
MOST_TRUSTED = 20_000
#: Mean log ratio (nats an n-gram) below which a text is dropped.
THRESHOLD = -0.7


def buckets(buf: np.ndarray, off: np.ndarray):
    """Pieces of (bucket, row) of all n-grams that lie within one text."""
    for at in range(0, len(buf) - GRAM + 1, STEP):
        piece = buf[at : at + STEP + GRAM - 1].astype(U)
        n = len(piece) - GRAM + 1
        key = piece[:n].copy()
        for j in range(1, GRAM):
            key = (key << U(8)) | piece[j : n + j]
        row = np.searchsorted(off, np.arange(at, at + n), "right") - 1
        inside = np.arange(at, at + n) + GRAM <= off[row + 1]
        yield ((key[inside] * U(0x9E3779B97F4A7C15)) >> U(64 - BITS)).astype(np.int64), row[inside]


def counts(marked: DataFrame) -> DataFrame:
    """(bucket, raw, trusted) summed over all texts; each task adds up its own before anything is shuffled."""
    bounded_batches(marked.sparkSession)

    def run(batches):
        raw, trusted = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in pieces(batches):
            good = np.asarray(batch.column("trusted").to_pylist(), bool)
            for bucket, row in buckets(*flat(batch.column("text"))):
                raw += np.bincount(bucket, minlength=1 << BITS)
                trusted += np.bincount(bucket[good[row]], minlength=1 << BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 << BITS, dtype=np.int32)), pa.array(raw), pa.array(trusted)], names=["bucket", "raw", "trusted"])

    part = marked.mapInArrow(run, "bucket int, raw long, trusted long")
    return part.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def ratios(docs: DataFrame, labels: DataFrame, label: str = "quality", most_trusted: int = MOST_TRUSTED) -> np.ndarray:
    """Log ratio of each bucket in units of 1 / UNIT nat."""
    good = labels.groupBy("doc_id").agg(F.min(label).alias("y")).where("y = 1 AND doc_id IS NOT NULL")
    chosen = good.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(most_trusted).select("doc_id", F.lit(True).alias("trusted"))
    marked = texts_of(docs).join(F.broadcast(chosen), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    raw, trusted = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r in counts(marked).collect():
        raw[r.bucket], trusted[r.bucket] = r.raw, r.trusted
    if not trusted.sum():
        return np.zeros(1 << BITS, np.int64)
    log_share = lambda x: np.log((x + 1) / (x.sum() + len(x)))
    return np.round((log_share(trusted) - log_share(raw)) * UNIT).astype(np.int64)


def mean_ratio(table: np.ndarray, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the table's entries and number of n-grams of each text."""
    total, n = np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1, np.int64)
    for bucket, row in buckets(buf, off):
        values = np.zeros(len(row) + 1, np.int64)
        np.cumsum(table[bucket], out=values[1:])
        edge = np.searchsorted(row, np.arange(len(off)))
        total += values[edge[1:]] - values[edge[:-1]]
        n += np.diff(edge)
    return total, n


def judged(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, most_trusted: int = MOST_TRUSTED) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_ratio."""
    table = ratios(docs, labels, most_trusted=most_trusted)

    def make():
        def step(batch):
            buf, off = flat(batch.column("text"))
            s = Stats(buf, off)
            total, n = mean_ratio(table, buf, off)
            good = total >= np.floor(threshold * UNIT) * n
            return {
                "doc_id": batch.column("doc_id"),
                **{k: getattr(s, k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")},
                "kept": good & ~s.base_failed,
                "log_ratio": total / np.maximum(n, 1) / UNIT,
            }

        return step

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, log_ratio double"
    return map_batches(texts_of(docs), make, schema)
