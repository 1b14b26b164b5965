"""Substring dedup by seed and extend.

Seeds. Winnowed word anchors (``winnow``) join the documents. Each occurrence of a window gets as partner the least
occurrence (by doc_id) of its kind among those of its anchor: runs of windows that agree as a whole get one together, the
runs at the edges of a repeat one for each window. Seeds on one diagonal, that is of one pair of texts at one distance,
are put together.

Extension. The partner's words travel to the text, and the match is extended from its seeds to the left and to the right
as far as the words themselves agree (``extended``). What is shorter than ``length`` words is dropped; the others are
maximal repeats against that partner, and are cut out of every document but the one with the smallest doc_id. Hashes
only propose.

No pair of documents is listed but a text and its partner: partners are found by aggregates with partial sums, so a
passage that a third of all documents share costs a row per occurrence.

Defined results: a null or empty text has no words; documents under ``length`` words lose nothing; rows
with the same doc_id never remove words of each other; equal rows are judged once and cut alike; a null doc_id counts
as larger than all others; an empty table gives no rows; very long texts are cut into chunks that hold each window
once. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.plans.stages import stash

from .batches import map_batches, texts_of
from .winnow import runs, windows
from .words import flat, hash_words, signed, split_words

LAST = (1 << 63) - 1


def keyed(docs: DataFrame) -> DataFrame:
    """did (doc_id, with null as the largest), th (a hash of the text) and text; did and th together tell rows apart that share a doc_id."""
    return texts_of(docs).select(F.coalesce("doc_id", F.lit(LAST)).alias("did"), F.xxhash64("text").alias("th"), "text")


def id_of(did: str = "did"):
    return F.when(F.col(did) != LAST, F.col(did)).alias("doc_id")


def run_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def make():
        def step(batch):
            buf, off = flat(batch.column("text"))
            starts, ends, first = split_words(buf, off)
            r = runs(hash_words(buf, starts, ends), first, length, gram)
            row = pa.array(r["row"])
            return {"did": batch.column("did").take(row), "th": batch.column("th").take(row), "anchor": signed(r["anchor"]), "run": signed(r["run"]), "start": r["start"], "n": r["n"]}

        return step

    return map_batches(texts.select("did", "th", "text"), make, "did long, th long, anchor long, run long, start int, n int")


def window_rows(listed: DataFrame, length: int) -> DataFrame:
    """(anchor, window, did, th, start) for the listed runs of each text."""

    def make():
        def step(batch):
            buf, off = flat(batch.column("text"))
            starts, ends, first = split_words(buf, off)
            values = hash_words(buf, starts, ends)
            out: dict[str, list] = {k: [] for k in ("row", "anchor", "window", "start")}
            for i, listed_runs in enumerate(batch.column("runs")):
                own = values[first[i] : first[i + 1]]
                for x in listed_runs.as_py():
                    w = windows(own, x["start"], x["n"], length)
                    out["row"].append(np.full(len(w), i))
                    out["anchor"].append(np.full(len(w), x["anchor"], np.int64))
                    out["window"].append(signed(w))
                    out["start"].append(np.arange(x["start"], x["start"] + x["n"]))
            got = {k: np.concatenate(v) for k, v in out.items()}
            row = pa.array(got["row"])
            return {"did": batch.column("did").take(row), "th": batch.column("th").take(row), **{k: got[k] for k in ("anchor", "window", "start")}}

        return step

    return map_batches(listed.select("did", "th", "text", "runs"), make, "did long, th long, anchor long, window long, start int")


def partners(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(did, th, start, n, first): n windows from start on, and the least (did, th, start) at which the same words seem to stand, of a smaller did."""
    rows = run_rows(texts, length, gram)
    shared = (
        rows.groupBy("anchor")
        .agg(F.min("did").alias("lo"), F.max("did").alias("hi"), (F.min("run") < F.max("run")).alias("differ"))
        .where("lo < hi")
        .select("anchor", "differ")
    )
    # sums become tables before they meet the rows again: a join of plain exchanges can be split at a hot key
    seeded = stash(rows.join(stash(shared, "shared"), "anchor"), "seeded")
    place = F.struct("did", "th", "start")
    firsts = seeded.groupBy("anchor", "run").agg(F.min(place).alias("first"))
    known = seeded.join(stash(firsts, "firsts"), ["anchor", "run"]).where("did > first.did OR differ")
    known = stash(known.select("did", "th", "anchor", "start", "n", F.when(F.col("did") > F.col("first.did"), F.col("first")).alias("first")), "known")
    whole = known.where("first IS NOT NULL").select("did", "th", "start", "n", "first")
    edges = known.where("first IS NULL").groupBy("did", "th").agg(F.collect_set(F.struct("anchor", "start", "n")).alias("runs"))
    each = window_rows(texts.join(edges, ["did", "th"]), length)
    least = each.groupBy("anchor", "window").agg(F.min(place).alias("first"), F.max("did").alias("hi")).where("first.did < hi").select("anchor", "window", "first")
    single = each.join(stash(least, "least"), ["anchor", "window"]).where("did > first.did").select("did", "th", "start", F.lit(1).alias("n"), "first")
    return whole.unionByName(single)


def diagonals(seeds: DataFrame, length: int) -> DataFrame:
    """(did, th, start, size, p_did, p_th, p_start): the words that the seeds of one text, partner and distance cover together."""
    ahead = (F.col("first.start") - F.col("start")).alias("ahead")
    seeds = seeds.select("did", "th", F.col("first.did").alias("p_did"), F.col("first.th").alias("p_th"), ahead, "start", "n")
    listed = seeds.groupBy("did", "th", "p_did", "p_th", "ahead").agg(F.collect_set(F.struct("start", "n")).alias("seeds"))

    def make():
        def step(batch):
            row, starts, sizes = [], [], []
            for i, x in enumerate(batch.column("seeds")):
                s = np.asarray(x.values.field("start"), np.int64)
                order = np.argsort(s)
                s, e = s[order], (s + np.asarray(x.values.field("n"), np.int64) - 1 + length)[order]
                reach = np.maximum.accumulate(e)
                heads = np.concatenate([[0], np.flatnonzero(s[1:] > reach[:-1]) + 1])
                row.append(np.full(len(heads), i))
                starts.append(s[heads])
                sizes.append(reach[np.append(heads[1:] - 1, len(s) - 1)] - s[heads])
            row, start = np.concatenate(row), np.concatenate(starts)
            at = pa.array(row)
            keep = {k: batch.column(k).take(at) for k in ("did", "th", "p_did", "p_th")}
            return keep | {"start": start, "size": np.concatenate(sizes), "p_start": start + np.asarray(batch.column("ahead"), np.int64)[row]}

        return step

    return map_batches(listed, make, "did long, th long, start int, size int, p_did long, p_th long, p_start int")


def words_of(asked: DataFrame) -> DataFrame:
    """(p_did, p_th, p_start, size, words): the words of the asked stretches, joined by one space."""

    def make():
        def step(batch):
            buf, off = flat(batch.column("text"))
            starts, ends, first = split_words(buf, off)
            data, out = buf.tobytes(), {k: [] for k in ("row", "p_start", "size", "words")}
            for i, listed in enumerate(batch.column("asked")):
                for x in listed.as_py():
                    a = int(first[i]) + x["p_start"]
                    out["row"].append(i)
                    out["p_start"].append(x["p_start"])
                    out["size"].append(x["size"])
                    out["words"].append(joined(data, starts, ends, a, a + x["size"]))
            row = pa.array(out.pop("row"), pa.int64())
            return {"p_did": batch.column("p_did").take(row), "p_th": batch.column("p_th").take(row), **out}

        return step

    return map_batches(asked, make, "p_did long, p_th long, p_start int, size int, words binary")


def joined(data: bytes, starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> bytes:
    return b" ".join([data[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)])


def extended(own: bytes, other: bytes, length: int) -> list[tuple[int, int]]:
    """(start, size) of the longest stretches, of at least ``length`` words, that agree word by word; both hold words joined by one space."""
    if own == other:
        return [(0, own.count(b" ") + 1)]
    same = np.array([x == y for x, y in zip(own.split(b" "), other.split(b" "), strict=False)], np.int8)
    turn = np.diff(same, prepend=0, append=0)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    return [(int(a), int(b - a)) for a, b in zip(starts, ends, strict=True) if b - a >= length]


def matches(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(did, th, cuts): for each text with seeds the stretches (start, size) that they cover and its partners' words there."""
    merged = stash(diagonals(partners(texts, length, gram), length), "diagonals")
    asked = merged.groupBy("p_did", "p_th").agg(F.collect_set(F.struct("p_start", "size")).alias("asked"))
    named = texts.select(F.col("did").alias("p_did"), F.col("th").alias("p_th"), "text").join(asked, ["p_did", "p_th"])
    # rows that share doc_id and text have the same words, and one of them serves
    there = stash(words_of(named).dropDuplicates(["p_did", "p_th", "p_start", "size"]), "words")
    met = merged.join(there, ["p_did", "p_th", "p_start", "size"])
    return met.groupBy("did", "th").agg(F.collect_list(F.struct("start", "size", "words")).alias("cuts"))


def kept_words(docs: DataFrame, length: int = 50, gram: int = 10, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space (kept_text), or their digest (kept_sha256)."""
    texts = keyed(docs)
    name = "kept_sha256" if digest else "kept_text"

    def make():
        def step(batch):
            buf, off = flat(batch.column("text"))
            starts, ends, first = split_words(buf, off)
            removed, kept = [], []
            cuts, data = batch.column("cuts"), buf.tobytes()
            for i in range(batch.num_rows):
                a, b = int(first[i]), int(first[i + 1])
                gone = np.zeros(b - a, bool)
                for x in cuts[i].as_py() or ():
                    own = joined(data, starts, ends, a + x["start"], a + x["start"] + x["size"])
                    for at, size in extended(own, x["words"], length):
                        gone[x["start"] + at : x["start"] + at + size] = True
                stay = np.flatnonzero(~gone) + a
                text = b" ".join([data[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)])
                removed.append(int(gone.sum()))
                kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            return {"doc_id": batch.column("doc_id"), "n_words": np.diff(first), "n_removed": removed, name: kept}

        return step

    return map_batches(texts.join(matches(texts, length, gram), ["did", "th"], "left").select(id_of(), "text", "cuts"), make, f"doc_id long, n_words long, n_removed long, {name} string")


def oracle(length: int = 50) -> str:
    """``kept_words`` with digests in DuckDB SQL, every window as text."""
    return f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + {length - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {length - 2})) AS i FROM d WHERE len(w) >= {length})),
least AS (SELECT s, min(doc_id) AS lo FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
cut AS (SELECT DISTINCT doc_id, unnest(range(i, i + {length})) AS p FROM win JOIN least USING (s) WHERE lo < doc_id),
each AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN cut USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
""".strip()
