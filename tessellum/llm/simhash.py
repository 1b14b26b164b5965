"""SimHash near-dedup by anchor-point covering.

A fingerprint's bits are majorities over the hashes of a text's word shingles. Two fingerprints link at
``links`` = 4 or fewer differing bits. The 64 bits form six blocks; six triples of blocks are such that
any four differing bits leave some triple with one differing bit or none. On 31 bits of a triple the
Hamming code is a covering code of radius 1 (the other bits stay as they are), and its words are the
anchors. Each fingerprint lives at its nearest anchor and is replicated to every anchor within
radius plus threshold, 1 + 1, so two fingerprints with at most one differing bit in the triple meet at
the anchor where one of them lives. All six triples together lose no link.

Equal fingerprints are one node, so copies make no pairs; the links are between different fingerprints
only. Components follow by alternating stars.

Defined results: a text without words (null, empty) has fingerprint zero and links like any other; a text
of fewer words than a shingle gives one shingle of all its words. Repeated rows share a component; a null
doc_id keeps its row and is no candidate for component_id unless its component has no other; an empty table gives
no rows; a very long text's shingles are hashed in parts. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellum.operators.components import components
from tessellum.plans.stages import stash

from .batches import fresh, map_batches, texts_of
from .words import flat, split_words

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bits of the six blocks, and the triples: for 4 differing bits in any blocks, one triple has 1 or none.
BLOCKS = np.split(np.arange(64), [11, 22, 33, 44, 54])
TRIPLES = [(0, 1, 2), (0, 1, 3), (0, 4, 5), (1, 4, 5), (2, 3, 4), (2, 3, 5)]
THRESHOLD = 4


def fingerprints_of(buf: np.ndarray, off: np.ndarray, shingle: int = 4, seed: int = 42) -> np.ndarray:
    starts, ends, first = split_words(buf, off)
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)])
    joined = np.full(int(at[-1]), 32, np.uint8)
    if len(starts):
        inside = np.zeros(len(buf) + 1, np.int8)
        np.add.at(inside, starts, 1)
        np.subtract.at(inside, ends, 1)
        letters = buf[np.cumsum(inside[:-1]).astype(bool)]
        joined[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = LOWER[letters]
    view, h = memoryview(joined.tobytes()), xxhash.xxh64_intdigest
    out = np.zeros(len(off) - 1, np.uint64)
    for r in range(len(out)):
        a, b = int(first[r]), int(first[r + 1])
        if a == b:
            continue
        k = min(shingle, b - a)
        lo, hi = at[a : b - k + 1].tolist(), (at[a + k - 1 : b] + size[a + k - 1 : b]).tolist()
        set_bits = np.zeros(64, np.int64)
        for c in range(0, len(lo), 65536):
            hashes = np.array([h(view[x:y], seed) for x, y in zip(lo[c : c + 65536], hi[c : c + 65536], strict=True)], np.uint64)
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            set_bits += bits.sum(0, dtype=np.int64)
        out[r] = np.packbits(set_bits * 2 > len(lo), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long)."""

    def make():
        return lambda batch: {"doc_id": batch.column("doc_id"), "fp": fingerprints_of(*flat(batch.column("text")), shingle).view(np.int64)}

    return map_batches(texts_of(docs), make, "doc_id long, fp long")


def _compact(fp: np.ndarray, triple: tuple[int, ...]) -> np.ndarray:
    bits = np.concatenate([BLOCKS[b] for b in triple])
    return sum((((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(j) for j, b in enumerate(bits)), np.zeros(len(fp), np.uint64))


#: For each syndrome, the sets of one or two of the 31 bits that lead from such a word to an anchor.
_TO_ANCHOR = [
    [0] if s == 0 else [1 << (s - 1), *(1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 32) if i < i ^ s)]
    for s in range(32)
]


def _syndrome(word: np.ndarray) -> np.ndarray:
    s = np.zeros(len(word), np.uint64)
    for j in range(31):
        s ^= ((word >> np.uint64(j)) & np.uint64(1)) * np.uint64(j + 1)
    return s.astype(np.int64)


def anchors_of(fp: np.ndarray, near_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor): each one's own anchor in each triple, or all anchors within 2."""
    index, key = [], []
    rows = np.arange(len(fp))
    for t, triple in enumerate(TRIPLES):
        word, mark = _compact(fp, triple), np.uint64(t << 40)
        s = _syndrome(word)
        own = word ^ np.where(s > 0, np.uint64(1) << np.maximum(s - 1, 0).astype(np.uint64), np.uint64(0))
        if near_only:
            index.append(rows)
            key.append(own | mark)
            continue
        for j in range(31, sum(len(BLOCKS[b]) for b in triple)):  # bits outside the code
            index.append(rows)
            key.append((own ^ np.uint64(1 << j)) | mark)
        for value in range(32):
            at = np.flatnonzero(s == value)
            for flip in _TO_ANCHOR[value]:
                index.append(at)
                key.append((word[at] ^ np.uint64(flip)) | mark)
    return np.concatenate(index), np.concatenate(key)


def _at_anchors(nodes: DataFrame, near_only: bool, name: str) -> DataFrame:
    def make():
        def step(batch):
            fp = batch.column("fp").to_numpy().view(np.uint64)
            index, key = anchors_of(fp, near_only)
            return {"anchor": key.view(np.int64), name: fp[index].view(np.int64)}

        return step

    return map_batches(nodes.select("fp"), make, f"anchor long, {name} long")


def links(nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b), a < b: different fingerprints of ``nodes.fp`` within the threshold; a pair may come up to six times."""
    if threshold > THRESHOLD:
        raise ValueError(f"the triples hold for up to {THRESHOLD} differing bits")
    # a fingerprint becomes about a hundred rows, so these are dealt over all tasks first; a number that is named isn't lowered by adaptive planning
    nodes = nodes.select("fp").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    living, sent = _at_anchors(nodes, True, "b"), _at_anchors(nodes, False, "a")
    return sent.join(living, (sent.anchor == living.anchor) & (F.bit_count(sent.a.bitwiseXOR(living.b)) <= threshold) & (sent.a < living.b)).select("a", "b")


def classes(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(fp, component_id) for rows (doc_id, fp)."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    member = components(links(nodes, threshold).distinct(), "a", "b")
    classed = nodes.join(member, nodes.fp == member.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = classed.groupBy("component").agg(F.min("least").alias("component_id"))
    return classed.join(ids, "component").select("fp", "component", "component_id")


def grouped(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = 4) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links, itself included)."""
    prints = stash(fingerprints(docs, shingle), "fingerprints")
    return prints.join(classes(prints, threshold), "fp").select("doc_id", "fp", "component_id")


def without_near_copies(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = 4) -> DataFrame:
    """One document of each component: of the smallest doc_id (null counts as the largest), of those the least text hash, of equal rows one."""
    did, th, nth = fresh(docs, "did", "th", "nth")
    named = docs.withColumn(did, F.coalesce("doc_id", F.lit((1 << 63) - 1))).withColumn(th, F.xxhash64(F.coalesce("text", F.lit(""))))

    def make():
        return lambda batch: {"did": batch.column("did"), "th": batch.column("th"), "fp": fingerprints_of(*flat(batch.column("text")), shingle).view(np.int64)}

    texts = named.select(F.col(did).alias("did"), F.col(th).alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    prints = stash(map_batches(texts, make, "did long, th long, fp long"), "fingerprints")
    of = classes(prints.select(F.col("did").alias("doc_id"), "fp"), threshold)
    # the least pair (did, th) of each component, by two plain minima
    rows = prints.join(of, "fp").where("did = component_id")
    keep = rows.groupBy("component").agg(F.min("did").alias(did), F.min("th").alias(th)).select(did, th).distinct()
    once = Window.partitionBy(did, th).orderBy(did)
    kept = named.join(keep, [did, th], "left_semi").withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1)
    return kept.select(*docs.columns)
