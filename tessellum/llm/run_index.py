"""Dedup of long byte strings by a run-compressed Burrows-Wheeler transform.

1. Winnowed byte anchors (``winnow``) bring equal 200-byte windows together. A run of windows that occurs
   again as a whole is settled by its hash; what remains are the runs at the edges of repeats.
2. Those runs, one of each kind, are dealt by anchor and indexed block by block: suffix order by rank
   doubling, its Burrows-Wheeler transform in run-compressed form, and text positions sampled at the ends
   of its runs alone. The longest match of a suffix is found by comparison at run ends; all other
   positions follow, because between run ends the match of the next position is one byte shorter.
   So the matching statistics stream over the text from the samples, and long matches are marked.
3. A block holds at most ``crowd`` kinds of runs. An anchor with more is split by what stands around it (``split``):
   its windows are halved by quarters of their places, and only stretches with the same bytes in common stay
   together, until each group fits a block of its own. So every size goes the same way.

Equal stretches are told by 126 bits of hashes (anchor and run) and indexed once; whether unequal ones share a long
string is decided by the index, which compares bytes.

Defined results: a null or empty text has 0 bytes and keeps nothing; equal rows repeat each other, so both
lose their long strings; a null doc_id stays null; an empty table gives no rows; texts over a chunk are cut into
chunks that hold each window once; other columns are ignored. Kept bytes may cut a character in two, since
strings are judged as bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.plans.stages import stash

from .batches import bounded_batches, map_batches, pieces
from .substring_dedup import id_of, keyed
from .winnow import cover, runs
from .words import BYTE_VALUE, Spans, flat, mix, signed

#: Bytes indexed together.
BLOCK = 1 << 20


class RunIndex:
    """The index of a list of segments; matches never cross them."""

    def __init__(self, segments: list[np.ndarray]):
        sizes = np.array([len(s) for s in segments], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        n = int(self.starts[-1])
        self.text = np.zeros(n, np.uint16)  # 0 ends a segment
        for s, at in zip(segments, self.starts, strict=False):
            self.text[at : at + len(s)] = s
            self.text[at : at + len(s)] += 1
        self.left = np.full(n, n, np.int64)  # bytes left in the segment
        for size, at in zip(sizes.tolist(), self.starts.tolist(), strict=False):
            self.left[at : at + size + 1] = np.arange(size, -1, -1)
        order = self._suffix_order(int(sizes.max(initial=0)))
        before = np.where(order > 0, self.text[order - 1], 0).astype(np.int64)
        before[before == 0] = 1000 + np.flatnonzero(before == 0)  # a segment's start continues no run
        heads = np.flatnonzero(before[1:] != before[:-1]) + 1
        self.heads = before[np.concatenate([[0], heads])] if n else before
        self.lengths = np.diff(np.concatenate([[0], heads, [n]]))
        self.run_ends = order[heads - 1]  # samples: the last position of a run and the first of the next
        self.run_starts = order[heads]

    def _suffix_order(self, depth: int) -> np.ndarray:
        n = len(self.text)
        if n < 2:
            return np.arange(n)
        padded = np.concatenate([self.text, np.zeros(4, np.uint16)]).astype(np.uint64)
        key = padded[:n].copy()
        for j in range(1, 4):
            key = (key << np.uint64(16)) | padded[j : n + j]
        have = 4
        while True:
            order = np.argsort(key)
            ordered = key[order]
            fresh = np.ones(n, np.int64)
            fresh[1:] = ordered[1:] != ordered[:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh)
            if have > depth or rank[order[-1]] == n:
                return order
            key = rank * (n + 1)
            key[:-have] += rank[have:]
            have *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffix a and suffix b, within their segments."""
        most = np.minimum(self.left[a], self.left[b])
        size = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        wide = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.text, np.zeros(16, np.uint16)]), 16)
        while len(live):
            x, y = wide[a[live] + size[live]], wide[b[live] + size[live]]
            same = np.where((x != y).any(1), (x != y).argmax(1), 16)
            size[live] += same
            live = live[(same == 16) & (size[live] < most[live])]
        return np.minimum(size, most)

    def matches(self, at_least: int) -> np.ndarray:
        """For each position, how far a match of at least that length reaches, of which it is part; 0 outside."""
        n = len(self.text)
        reach = np.zeros(n + 1, np.int64)
        fit = (self.left[self.run_ends] >= at_least) & (self.left[self.run_starts] >= at_least)
        a, b = self.run_ends[fit], self.run_starts[fit]
        size = self.common(a, b)
        long_ = size >= at_least
        for p in (a[long_], b[long_]):
            np.maximum.at(reach, p, p + size[long_])
        return np.maximum.accumulate(reach[:n])

    def marked(self, at_least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, start, length) of the maximal stretches that long matches cover."""
        n = len(self.text)
        inside = np.zeros(n + 2, np.int8)
        inside[1 : n + 1] = self.matches(at_least) > np.arange(n)
        turn = np.diff(inside)
        s, e = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        seg = np.searchsorted(self.starts, s, "right") - 1
        return seg, s - self.starts[seg], e - s


def run_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def make():
        def step(batch):
            buf, off = flat(batch.column("text"))
            r = runs(BYTE_VALUE[buf], off, length, gram)
            row = pa.array(r["row"])
            return {"did": batch.column("did").take(row), "th": batch.column("th").take(row), "anchor": signed(r["anchor"]), "run": signed(r["run"]), "start": r["start"], "n": r["n"]}

        return step

    return map_batches(texts.select("did", "th", "text"), make, "did long, th long, anchor long, run long, start int, n int")


def segment_rows(listed: DataFrame, length: int) -> DataFrame:
    """(anchor, crowded, did, th, start, n, bytes) of the listed runs."""

    def make():
        def step(batch):
            buf, off = flat(batch.column("text"))
            out: dict[str, list] = {k: [] for k in ("row", "anchor", "crowded", "start", "n", "bytes")}
            for i, listed_runs in enumerate(batch.column("runs")):
                for x in listed_runs.as_py():
                    at = int(off[i]) + x["start"]
                    out["row"].append(i)
                    for k in ("anchor", "crowded", "start", "n"):
                        out[k].append(x[k])
                    out["bytes"].append(buf[at : at + x["n"] - 1 + length].tobytes())
            row = pa.array(out["row"], pa.int64())
            return {"did": batch.column("did").take(row), "th": batch.column("th").take(row), **{k: v for k, v in out.items() if k != "row"}}

        return step

    return map_batches(listed.select("did", "th", "text", "runs"), make, "did long, th long, anchor long, crowded boolean, start int, n int, bytes binary")


def index_blocks(segments: DataFrame, length: int) -> DataFrame:
    """(did, th, start, size) of long matches, by a run index of each block of anchors."""
    bounded_batches(segments.sparkSession)

    def found(rows: list[tuple]):
        index = RunIndex([np.frombuffer(r[4], np.uint8) for r in rows])
        seg, start, size = index.marked(length)
        base = np.array([r[3] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][1] for i in seg.tolist()], pa.int64()),
                pa.array([rows[i][2] for i in seg.tolist()], pa.int64()),
                pa.array((base[seg] + start).astype(np.int32)),
                pa.array(size.astype(np.int32)),
            ],
            names=["did", "th", "start", "size"],
        )

    def run(batches):
        held, anchor, total = [], None, 0
        for batch in pieces(batches):
            for r in zip(*(batch.column(k).to_pylist() for k in ("anchor", "did", "th", "start", "bytes")), strict=True):
                if held and r[:4] == held[-1][:4]:  # of equal rows one serves
                    continue
                if total >= BLOCK and r[0] != anchor:
                    yield found(held)
                    held, total = [], 0
                held.append(r)
                anchor, total = r[0], total + len(r[4])
        if held:
            yield found(held)

    dealt = segments.select("anchor", "did", "th", "start", "bytes").repartition("anchor").sortWithinPartitions("anchor", "did", "th", "start")
    return dealt.mapInArrow(run, "did long, th long, start int, size int")


def _node_hashes(live: DataFrame, level: int, length: int, gram: int) -> DataFrame:
    """``live`` with lo, hi (the windows of node q that the segment has), core and span.

    A window is named by the bytes it has before the anchor. Node q of a level is the windows with
    q * 2**level or more and fewer than (q + 1) * 2**level. core hashes the bytes common to all of them,
    span the bytes they cover together; span is null where the segment lacks some of them.
    """
    width = length - gram + 1

    def make():
        def step(batch):
            n = batch.num_rows
            lo, hi, ahead, core, span = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64), []
            columns = (batch.column(k).to_pylist() for k in ("bytes", "anchor", "n", "q"))
            for i, (b, anchor, count, q) in enumerate(zip(*columns, strict=True)):
                spans = Spans(BYTE_VALUE[np.frombuffer(b, np.uint8)])
                before = int(np.flatnonzero(signed(mix(spans.all(gram)[:width])) == anchor)[0])  # of the first window
                first, end = q << level, min(q + 1 << level, width)
                lo[i], hi[i] = max(first, before - count + 1), min(end, before + 1)
                ahead[i] = before
                tag = np.uint64((level << 32) + q)
                of = lambda x, y: signed(mix(spans.of(np.array([x]), np.array([y])) + mix(np.array([tag]))))[0]
                if lo[i] < hi[i]:
                    core[i] = of(before - first, before - end + 1 + length)
                span.append(int(of(before - end + 1, before - first + length)) if (lo[i], hi[i]) == (first, end) else None)
            kept = {k: batch.column(k) for k in ("anchor", "did", "th", "start", "n", "bytes", "q")}
            return kept | {"lo": lo, "hi": hi, "before": ahead, "core": core, "span": span}

        return step

    schema = "anchor long, did long, th long, start int, n int, bytes binary, q int, lo int, hi int, before int, core long, span long"
    return map_batches(live, make, schema).where("lo < hi")


def split(segments: DataFrame, length: int, gram: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Of segments with crowded anchors: (marks, groups). Marks (did, th, start, size) are stretches that others equal;
    groups (anchor, did, th, start, bytes) of at most ``crowd`` stretches go to the index, under a name of their own.

    From all windows of an anchor down to single ones, by fours: a stretch whose core nobody shares is out, one that
    others equal as a whole is marked, and of each such kind one goes on, for the others may share a part of it. A group
    of few goes to the index; one of many is split, and all windows of a last one are equal. So a segment costs a few
    rows a level, however many share its anchor, and a level is sums and joins by keys.
    """
    live = segments.select("anchor", "did", "th", "start", "n", "bytes", F.lit(0).alias("q"))
    marks = groups = None
    for level in (8, 6, 4, 2, 0):
        node = stash(_node_hashes(live, level, length, gram), "nodes")
        key = ["anchor", "q", "core"]
        met = node.groupBy(*key).agg(F.count("*").alias("c"), F.min("span").alias("s0"), F.max("span").alias("s1"), F.count("span").alias("cs"))
        met = stash(met.where("c > 1").select(*key, F.expr("cs < c OR s0 < s1").alias("differ")), "cores")
        one = [F.first(k).alias(f"{k}_1") for k in ("did", "th", "start")]
        again = node.where("span IS NOT NULL").groupBy(*key, "span").agg(F.count("*").alias("c"), *one)
        again = stash(again.where("c > 1").select(*key, "span", "did_1", "th_1", "start_1", F.lit(True).alias("settled")), "spans")
        left = stash(node.join(met, key).join(again, [*key, "span"], "left"), "shared")
        begin, size = F.col("start") + F.col("before") - F.col("hi") + 1, F.col("hi") - F.col("lo") - 1 + length
        found = left.where("settled").select("did", "th", begin.alias("start"), size.alias("size"))
        marks = found if marks is None else marks.unionByName(found)
        onward = left.where("settled IS NULL OR (differ AND did = did_1 AND th = th_1 AND start = start_1)")
        if not level:  # all windows of a group are equal here
            break
        many = stash(onward.groupBy(*key).agg(F.count("*").alias("k")).where(F.col("k") > crowd).select(*key, F.lit(True).alias("many")), "many")
        onward = stash(onward.join(many, key, "left"), "onward")
        own = F.substring("bytes", F.col("before") - F.col("hi") + 2, size)
        fit = onward.where("many IS NULL").select(F.xxhash64(F.lit(level), *key).alias("anchor"), "did", "th", begin.alias("start"), own.alias("bytes"))
        groups = fit if groups is None else groups.unionByName(fit)
        part = 1 << (level - 2)  # the quarters in which the segment has windows
        quarters = F.sequence(F.floor(F.col("lo") / part).cast("int"), F.floor((F.col("hi") - 1) / part).cast("int"))
        live = onward.where("many").select("anchor", "did", "th", "start", "n", "bytes", F.explode(quarters).alias("q"))
    return marks, groups


def repeats(docs: DataFrame, length: int, gram: int, crowd: int) -> DataFrame:
    """(did, th, start, size): stretches of bytes that long repeats cover. Equal rows share a set, rightly: each repeats the other."""
    rows = run_rows(docs, length, gram)
    shared = rows.groupBy("anchor").agg(F.count("*").alias("c"), (F.min("run") < F.max("run")).alias("differ")).where("c > 1").select("anchor", "differ")
    # sums become tables before they meet the rows again: a join of plain exchanges can be split at a hot key
    seeded = stash(rows.join(stash(shared, "shared"), "anchor"), "seeded")
    # any occurrence serves as the one of its kind, for equal runs have equal bytes
    one = [F.first(k).alias(k) for k in ("did", "th", "start", "n", "differ")]
    kinds = seeded.groupBy("anchor", "run").agg(F.count("*").alias("c"), *one)
    kinds = stash(kinds.where("c > 1 OR differ"), "kinds")
    many = kinds.where("c > 1").select("anchor", "run")
    whole = seeded.join(many, ["anchor", "run"]).select("did", "th", "start", (F.col("n") - 1 + length).alias("size"))
    differing = kinds.where("differ").select("anchor", "did", "th", "start", "n")
    crowds = stash(differing.groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > crowd).select("anchor", F.lit(True).alias("crowded")), "crowds")
    dealt = differing.join(crowds, "anchor", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    listed = dealt.groupBy("did", "th").agg(F.collect_set(F.struct("anchor", "crowded", "start", "n")).alias("runs"))
    segments = stash(segment_rows(docs.join(listed, ["did", "th"]), length), "segments")
    marks, groups = split(segments.where("crowded"), length, gram, crowd)
    dealt = segments.where("NOT crowded").select("anchor", "did", "th", "start", "bytes").unionByName(groups)
    return whole.unionByName(marks).unionByName(index_blocks(dealt, length))


def kept_bytes(docs: DataFrame, length: int = 200, gram: int = 32, crowd: int = 256, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the remaining bytes (kept), or their digest (kept_sha256)."""
    texts = keyed(docs)
    cuts = repeats(texts, length, gram, crowd).groupBy("did", "th").agg(F.collect_set(F.struct("start", "size")).alias("cuts"))
    name, kind = ("kept_sha256", "string") if digest else ("kept", "binary")

    def make():
        def step(batch):
            buf, off = flat(batch.column("text"))
            cuts = batch.column("cuts")
            removed, spans, kept = [], [], []
            for i in range(batch.num_rows):
                own = buf[off[i] : off[i + 1]]
                listed = cuts[i].values if cuts[i].is_valid else None
                if listed is not None and len(listed):
                    s = np.asarray(listed.field("start"), np.int64)
                    gone = cover(len(own), s, s + np.asarray(listed.field("size"), np.int64))
                    removed.append(int(gone.sum()))
                    spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    own = own[~gone]
                else:
                    removed.append(0)
                    spans.append(0)
                kept.append(hashlib.sha256(own.tobytes()).hexdigest() if digest else own.tobytes())
            return {"doc_id": batch.column("doc_id"), "n_bytes": np.diff(off), "n_removed": removed, "n_spans": spans, name: kept}

        return step

    return map_batches(texts.join(cuts, ["did", "th"], "left").select(id_of(), "text", "cuts"), make, f"doc_id long, n_bytes long, n_removed long, n_spans long, {name} {kind}")
