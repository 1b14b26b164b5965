"""Alignment of two tokenizers' tokens over the same bytes.

A is a byte-level BPE vocabulary (``prefix_trie``), which gets a space and the text; B is a SentencePiece model, which puts that
space itself. Both sequences of token ends, counted in bytes, are merged with two pointers: a step goes to the next end of
either side, and the pointers whose token ends there go on. Every step is one link, since between two ends stands one
token of A and one of B; a step at which both go on closes a group. ``merge`` does it for a whole batch of texts at once, as texts begin
and end on both sides together; a pointer's place at a step is the number of its ends before.

The merge runs inside mapInArrow, which is mapInPandas without a pandas copy (there a null among the ids would turn
the others into floats). It writes one table with a row a text and, for each batch, a row for each pair linked in it, with the texts that
hold it. So a pair is counted before it is shuffled, and all copies of a frequent pair travel in one row a batch. Spark adds up
the pairs' counts, joins them with the maxima of both sides, and brings both back to the batches, where they are added up by text.

Defined results: a text is null, empty, or joins to other bytes than space and text (it holds U+2581, say): no tokens, zeros,
groups ''. Each row is a document, so repeated rows count each and get the same columns; a null ``doc_id`` stays null; an empty
table gives no rows; special strings are plain text; a very long text is a batch of its own; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.plans.stages import stash

from .batches import kept, map_batches, texts_of
from .prefix_trie import Known, vocabulary

SPACE = "▁"
BYTE = re.compile("<0x([0-9A-F]{2})>")


#: Stands for a word whose pieces join to something else.
OTHER = array("i", [-1]).tobytes()


class Pieces:
    """A SentencePiece model over texts that get a space in front.

    If no piece has the space sign after another character, no piece crosses the beginning of a word with its spaces,
    so texts are cut there and words met lately are looked up.
    """

    def __init__(self, path: str, keep: int = 300_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes((int(m[1], 16),)) if (m := BYTE.fullmatch(p)) else p.replace(SPACE, " ").encode() for p in names]
        self.blank = names.index(SPACE)
        cut = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in names)
        self.words = re.compile(r" +[^ ]*" if cut else r"(?s).+")
        self.known = Known(self._of, keep)

    def release(self) -> None:
        self.known.release()

    def _of(self, words: set[str]) -> dict[str, bytes]:
        """The model puts a word's first space itself."""
        listed = list(words)
        out = {}
        for word, ids in zip(listed, self.model.encode([w[1:] for w in listed], num_threads=1), strict=True):
            ids = ids if len(word) > 1 else [self.blank]
            out[word] = array("i", ids).tobytes() if b"".join(map(self.bytes.__getitem__, ids)) == word.encode() else OTHER
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """The ids of texts that begin with a space; None if they join to something else."""
        found = [self.words.findall(x) for x in texts]
        table = self.known.holding(set().union(*found))
        ids = [np.frombuffer(b"".join(map(table.__getitem__, x)), np.int32) for x in found]
        return [None if len(x) and x.min() < 0 else x for x in ids]


def merge(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every step: its end, the pointers into A and B, and whether both go on. Both arrays end at the same byte."""
    total = int(ends_a[-1]) if len(ends_a) else 0
    on = np.zeros(total + 1, np.uint8)
    on[ends_a] = 1
    on[ends_b] |= 2
    steps = np.flatnonzero(on)
    on = on[steps]
    goes_a, goes_b = on & 1, on >> 1
    return steps, np.cumsum(goes_a) - goes_a, np.cumsum(goes_b) - goes_b, on == 3


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = vocabulary(path_a), Pieces(path_b)
        self.size_a = np.array([len(x) for x in self.a.bytes], np.int64)
        self.size_b = np.array([len(x) for x in self.b.bytes], np.int64)
        # each id before a comma, and as the last of its side in a group
        self.names = [b"%d%c" % (i, end) for i in range(len(self.a.bytes)) for end in b",|"] + [b"%d%c" % (i, end) for i in range(len(self.b.bytes)) for end in b",;"]

    def release(self) -> None:
        self.b.release()

    def align(self, texts: list[str]) -> Aligned:
        texts = [x and f" {x}" for x in texts]
        own = iter(self.b.encode([x for x in texts if x]))
        b = [next(own) if x else None for x in texts]
        a = iter(self.a.encode([x for x, y in zip(texts, b, strict=True) if y is not None], specials=False))
        none = np.zeros(0, np.int32)
        return Aligned(self, [none if y is None else next(a) for y in b], [none if y is None else y for y in b])


class Aligned:
    """What the merge gives for a batch of texts."""

    def __init__(self, aligner: Aligner, a: list[np.ndarray], b: list[np.ndarray]):
        self.aligner = aligner
        self.n_a, self.n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        self.a, self.b = np.concatenate([*a, np.zeros(0, np.int32)]), np.concatenate([*b, np.zeros(0, np.int32)])
        ends_a, ends_b = np.cumsum(aligner.size_a[self.a]), np.cumsum(aligner.size_b[self.b])
        text_ends = np.concatenate([[0], ends_a])[np.cumsum(self.n_a)]
        steps, self.at_a, self.at_b, self.closes = merge(ends_a, ends_b)
        first = np.searchsorted(steps, text_ends, "right")
        self.n_links = np.diff(first, prepend=0)
        closed = np.concatenate([[0], np.cumsum(self.closes)])
        self.n_groups = np.diff(closed[first], prepend=0)

    def groups(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for each text: A's and B's ids of each group."""
        opened = np.cumsum(self.closes) - self.closes  # the group of each step
        of_a, of_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        of_a[self.at_a], of_b[self.at_b] = opened, opened
        last_a, last_b = np.diff(of_a, append=-1) != 0, np.diff(of_b, append=-1) != 0
        order = np.zeros(len(self.a) + len(self.b), np.int64)
        # a token of A stands after B's of the groups before, one of B after A's of its own group as well
        order[np.arange(len(self.a)) + np.searchsorted(of_b, of_a, "left")] = 2 * self.a.astype(np.int64) + last_a
        order[np.arange(len(self.b)) + np.searchsorted(of_a, of_b, "right")] = 2 * (len(self.aligner.a.bytes) + self.b.astype(np.int64)) + last_b
        names, out, at = self.aligner.names.__getitem__, [], 0
        for n in (self.n_a + self.n_b).tolist():
            out.append(b"".join(map(names, order[at : at + n].tolist()))[:-1])
            at += n
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each pair linked in the batch, as A's id times B's size plus B's id; where its entries begin; per entry the text's number and its links."""
        rows = max(len(self.n_a), 1)
        row = np.repeat(np.arange(len(self.n_links)), self.n_links)
        key = np.sort((self.a[self.at_a].astype(np.int64) * len(self.aligner.b.bytes) + self.b[self.at_b]) * rows + row)
        begin = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.diff(begin, append=len(key))
        pair, text = key[begin] // rows, key[begin] % rows
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        return pair[first], np.append(first, len(pair)), text, times


def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker process. The vocabularies stay, so the collector needn't look at them again."""
    vocabulary(path_a)

    def build() -> Aligner:
        got = Aligner(path_a, path_b)
        gc.freeze()
        return got

    return kept(f"alignment {path_a} {path_b}", build)


_LINKED = "batch long, pair long, held long, entries array<long>, row int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def linked(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of texts (``row`` not null) and rows of a batch's pairs (``pair`` not null): ``held`` texts of it, each an entry of its number in the batch
    times 2**32 plus its links. A batch's number is its task's and its own there; it is only sure once the rows are written."""

    def make():
        al = aligner(path_a, path_b)
        numbers = count((TaskContext.get().partitionId() if TaskContext.get() else 0) << 32)
        sha = lambda x: hashlib.sha256(x).hexdigest() if x else ""

        def step(batch):
            got = al.align(batch.column("text").to_pylist())
            pair, first, text, times = got.pairs()
            rows, own = batch.num_rows, len(pair)
            blank = lambda n, kind: pa.nulls(n, kind)
            both = lambda above, below, kind: pa.concat_arrays([pa.array(above, kind) if not isinstance(above, pa.Array) else above, pa.array(below, kind) if not isinstance(below, pa.Array) else below])
            entries = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array((text << 32) + times, pa.int64()))
            long, no = pa.int64(), blank(own, pa.int64())
            return {
                "batch": np.full(rows + own, next(numbers)),
                "pair": both(blank(rows, long), pair, long),
                "held": both(blank(rows, long), np.diff(first), long),
                "entries": both(blank(rows, pa.list_(long)), entries, pa.list_(long)),
                "row": both(np.arange(rows, dtype=np.int32), blank(own, pa.int32()), pa.int32()),
                "doc_id": both(batch.column("doc_id"), no, long),
                "n_a": both(got.n_a, no, long),
                "n_b": both(got.n_b, no, long),
                "n_groups": both(got.n_groups, no, long),
                "n_links": both(got.n_links, no, long),
                "groups_sha256": both([sha(x) for x in got.groups()], blank(own, pa.string()), pa.string()),
            }

        return step

    return map_batches(texts_of(docs), make, _LINKED)


def _counts(table: DataFrame, size_b: int) -> DataFrame:
    """pair, a, b, held, best_a and best_b (whether no other pair of that id has more documents) of each pair of a written ``linked`` table."""
    counts = stash(
        table.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("held").alias("held")).select("pair", F.expr(f"pair div {size_b}").alias("a"), F.expr(f"pair % {size_b}").alias("b"), "held"),
        "pair_counts",
    )
    for side in ("a", "b"):
        counts = counts.join(counts.groupBy(side).agg(F.max("held").alias(f"most_{side}")), side)
    return counts.select("pair", "a", "b", "held", *(F.expr(f"held = most_{s}").alias(f"best_{s}") for s in ("a", "b")))


def _size_b(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """a, b, held, best_a, best_b: each pair of ids linked anywhere, the documents that hold it, and whether it is its ids' most frequent."""
    return _counts(stash(linked(docs, path_a, path_b), "linked"), _size_b(path_b)).drop("pair")


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_best_b of every text."""
    table = stash(linked(docs, path_a, path_b), "linked")
    told = table.where("pair IS NOT NULL").select("pair", "batch", "entries").join(_counts(table, _size_b(path_b)).select("pair", "held", "best_a", "best_b"), "pair")
    sums = (
        told.repartition("batch")  # whole batches, so texts add up where they are
        .select("batch", "held", "best_a", "best_b", F.explode("entries").alias("entry"))
        .select("batch", F.shiftright("entry", 32).cast("int").alias("row"), F.col("entry").bitwiseAND(0xFFFFFFFF).alias("n"), "held", "best_a", "best_b")
        .groupBy("batch", "row")
        .agg(*(F.sum(F.expr(x)).alias(n) for n, x in (("n_best", "if(best_a, n, 0)"), ("count_sum", "n * held"), ("n_best_b", "if(best_b, n, 0)"))))
    )
    texts = table.where("row IS NOT NULL").select("batch", "row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return texts.join(sums, ["batch", "row"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", zero("n_best_b"))


def token_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, groups: the groups themselves, ``a1,a2|b1;a3|b2,b3``."""

    def make():
        al = aligner(path_a, path_b)
        return lambda batch: {"doc_id": batch.column("doc_id"), "groups": [x.decode() for x in al.align(batch.column("text").to_pylist()).groups()]}

    return map_batches(texts_of(docs), make, "doc_id long, groups string")
