"""Tagged documents: facets, inverted index, co-occurrence and related items."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions.text import matches_search
from tessellum.plans.stages import ship
from tessellum.plans.stages import spread as stash


def facet_filter(docs: DataFrame, *, facets: dict[str, object | None], text: Column | None = None, search: str | None = None) -> DataFrame:
    """Rows that meet every facet (array columns by membership, others by equality) and the search; a null facet asks nothing."""
    out = docs
    kinds = dict(docs.dtypes)
    for name, wanted in facets.items():
        if wanted is not None:
            out = out.where(F.array_contains(name, wanted) if kinds[name].startswith("array") else F.col(name) == F.lit(wanted))
    return out if text is None else out.where(matches_search(text, search))


@dataclass(frozen=True)
class Selection:
    """What a reader has selected."""

    search: str = ""
    tag: str | None = None
    region: str | None = None

    def toggled(self, **facet: str) -> Selection:
        """The same facet again clears it."""
        (name, value), *_ = facet.items()
        return replace(self, **{name: None if getattr(self, name) == value else value})

    def jumped(self, **facet: str) -> Selection:
        """One facet set, all others cleared."""
        return Selection(**facet)


def lookup_distinct(keys: Column, table: dict[str, str]) -> Column:
    """The distinct values of a dimension for an array of keys, in the keys' order; unknown keys give none."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else F.create_map().cast("map<string,string>")
    return F.array_distinct(F.filter(F.transform(keys, lambda k: F.try_element_at(pairs, k)), lambda v: v.isNotNull()))


def inverted_index(docs: DataFrame, key: str, *, doc: str, tag: str, order: str | None = None) -> DataFrame:
    """For each key: weight (rows, repeats included), distinct tags sorted, and with ``order`` the last tag by it."""
    aggs = [F.count(F.lit(1)).alias("weight"), F.sort_array(F.collect_set(tag)).alias("tags")]
    if order:
        aggs.append(F.max_by(tag, order).alias("last_tag"))
    return docs.groupBy(key).agg(*aggs)


def cooccurrence(items: DataFrame, *, group: str, item: str) -> DataFrame:
    """(a, b, n), a < b: groups in which both items are. The join is within a group; groups must be small, as order lines are."""
    left, right = items.select(group, F.col(item).alias("a")).distinct(), items.select(group, F.col(item).alias("b")).distinct()
    # as many tasks as rows ask for, so that the pairs of one fit its memory
    parts = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), items.count() // 500_000)
    return left.join(right, group).where("a < b").repartition(parts, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"))


def link_orientation(items: DataFrame, *, group: str, item: str, order: str) -> DataFrame:
    """(source, target, n, groups) with repeats counted: a pair keeps the orientation in which it is first met, and an item repeated in a group links to itself."""
    x = items.select(group, order, item, F.col("pos")).alias("x")
    y = items.select(F.col(group).alias("g2"), F.col(item).alias("other"), F.col("pos").alias("pos2")).alias("y")
    met = x.join(y, (F.col(group) == F.col("g2")) & (F.col("pos") < F.col("pos2")))
    key = [F.least(item, "other").alias("k1"), F.greatest(item, "other").alias("k2")]
    first = F.min(F.struct(order, "pos", "pos2", F.col(item).alias("source"), F.col("other").alias("target")))
    got = met.groupBy(*key).agg(first.alias("f"), F.count("*").alias("n"), F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct(order, "pos", "pos2", group))), lambda s: s[group])).alias("groups"))
    return got.select("f.source", "f.target", "n", "groups")


def neighbours(links: DataFrame, of: object, *, a: str = "a", b: str = "b") -> DataFrame:
    """(node): nodes linked to ``of`` in either direction."""
    return links.where(F.col(a) == F.lit(of)).select(F.col(b).alias("node")).unionByName(links.where(F.col(b) == F.lit(of)).select(F.col(a).alias("node"))).distinct()


#: Tokens of more items of a block than this are added up item by item, others pair by pair; items of a block at most, blocks where there are few items, and entries of a block, roughly.
COMMON, OWN, BLOCKS, HELD = 16, 5000, 12, 4_000_000
#: Pairs of items that are added up at once, and items whose best are sought at once.
AT_ONCE, STRIP = 2_000_000, 500


class _Block:
    """The items of a block, in order, and of every token the places of the items that have it."""

    KINDS = {"items": "<i8", "tokens": "<i8", "ends": "<i8", "at": "<i4"}

    def __init__(self, items: np.ndarray, tokens: np.ndarray, ends: np.ndarray, at: np.ndarray):
        self.items, self.tokens, self.ends, self.at = items, tokens, ends, at

    @classmethod
    def read(cls, row: dict, side: str) -> _Block:
        return cls(*(np.frombuffer(row[side + k], kind) for k, kind in cls.KINDS.items()))


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row: the block of the rows (x, id, tag); a tag of -1 is none."""
    x, id, tag = (pdf[c].to_numpy("int64") for c in ("x", "id", "tag"))
    items, at = np.unique(x, return_inverse=True)
    known = tag != -1
    id, at = np.concatenate([id, tag[known]]), np.concatenate([at, at[known]])
    order = np.lexsort((at, id))
    id, at = id[order], at[order]
    new = np.ones(len(id), bool)
    new[1:] = (id[1:] != id[:-1]) | (at[1:] != at[:-1])
    id, at = id[new], at[new]
    tokens, first = np.unique(id, return_index=True)
    held = (items, tokens, np.append(first, len(id)), at)
    return pd.DataFrame([(int(pdf["block"].iloc[0]), *(v.astype(kind).tobytes() for v, kind in zip(held, _Block.KINDS.values(), strict=True)))], columns=["block", *_Block.KINDS])


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each span, end to end."""
    return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


def _scores(a: _Block, b: _Block, weights: tuple[float, float], common: int) -> np.ndarray:
    """The weights of all tokens that an item of a (row) and one of b (column) share; an odd token has the second weight."""
    out = np.zeros((len(a.items), len(b.items)))
    both, i, j = np.intersect1d(a.tokens, b.tokens, assume_unique=True, return_indices=True)
    a0, n, b0, m = a.ends[i], a.ends[i + 1] - a.ends[i], b.ends[j], b.ends[j + 1] - b.ends[j]
    odd = (both & 1).astype(bool)
    often = np.maximum(n, m) > common

    # items that have the same of these tokens have the same sums
    o = np.flatnonzero(often)
    item, token = a.at[_spans(a0[o], n[o])], np.repeat(np.arange(len(o)), n[o])
    order = np.argsort(item, kind="stable")
    token, starts = token[order], np.searchsorted(item[order], np.arange(len(a.items) + 1))
    at = b.at.astype("int64")
    lists = [at[k : k + h] for k, h in zip(b0[o].tolist(), m[o].tolist(), strict=True)]
    seen: dict[bytes, int] = {}
    for x in range(len(a.items)):
        mine = token[starts[x] : starts[x + 1]]
        if len(mine) and (first := seen.setdefault(hashlib.sha256(mine.tobytes()).digest(), x)) != x:
            out[x] = out[first]
            continue
        for weight, some in zip(weights, (mine[~odd[o[mine]]], mine[odd[o[mine]]]), strict=True):
            if len(some):
                out[x] += weight * np.bincount(np.concatenate([lists[k] for k in some.tolist()]), minlength=len(b.items))

    o = np.flatnonzero(~often)
    flat, size = out.reshape(-1), n[o] * m[o]
    upto = np.cumsum(size)
    cut = np.append(np.searchsorted(upto, np.arange(0, upto[-1] if len(o) else 0, AT_ONCE)), len(o))
    for f, t in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        k = np.repeat(o[f:t], size[f:t])
        within = _spans(np.zeros(t - f, "int64"), size[f:t])
        np.add.at(flat, a.at[a0[k] + within // m[k]].astype("int64") * len(b.items) + at[b0[k] + within % m[k]], np.where(odd[k], weights[1], weights[0]))
    return out


def _best(limit: int, weights: tuple[float, float], common: int):
    """For pairs of blocks: of each item of either the best items of the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                a, b = _Block.read(row, "a_"), _Block.read(row, "b_")
                score = _scores(a, b, weights, common)
                sides = [(a, b, lambda f, t: score[f:t]), (b, a, lambda f, t: np.ascontiguousarray(score[:, f:t].T))]
                if row["a_block"] == row["b_block"]:
                    np.fill_diagonal(score, 0.0)
                    sides = sides[:1]
                for own, other, strip in sides:
                    for f in range(0, len(own.items), STRIP):
                        found = strip(f, f + STRIP)
                        tops = [_top(other.items, line, limit) for line in found]
                        n = [len(k) for k in tops]
                        x, k = np.repeat(np.arange(len(tops)), n), np.concatenate(tops)
                        got = pd.DataFrame({"x": own.items[f + x], "y": other.items[k], "score": found[x, k]})
                        yield got[got["score"] > 0]

    return run


def _top(ids: np.ndarray, score: np.ndarray, limit: int) -> np.ndarray:
    """Places of the highest scores, ties by the smaller id."""
    if len(ids) > limit:
        some = np.flatnonzero(score >= np.partition(score, len(score) - limit)[len(score) - limit])
    else:
        some = np.arange(len(ids))
    return some[np.lexsort((ids[some], -score[some]))[:limit]]


def _numbers(values: DataFrame, name: str) -> DataFrame:
    """(name, number): numbers in the order of the values."""
    return stash(values.select(name).where(F.col(name).isNotNull()).distinct().repartitionByRange(name).sortWithinPartitions(name).withColumn("number", F.monotonically_increasing_id()), "numbers")


def related(tokens: DataFrame, *, item: str, token: str, weight: float, limit: int, tags: DataFrame | None = None, tag: str = "tag", tag_weight: float = 1, common: int = COMMON) -> DataFrame:
    """(item, other, score, place): other items by ``weight`` for every shared token and ``tag_weight`` for every shared tag of tokens, best first; ties by the other item.

    ``tags`` (token, tag): an item has the tags of its tokens. Repeats count once.

    Items are dealt in blocks, each one row that holds of every token which items have it. Every two blocks meet in one task, which adds up the scores of all their pairs and keeps each
    item's best; blocks are shuffled once and read again by each task that needs them, so what is on disk grows with the rows of ``tokens`` (and by ``limit`` rows an item and block), though
    all items meet all others in time. Tokens of more than ``common`` items of a block are added up once for all items of it that have the same of them.
    Keys that are whole numbers stand for themselves (tokens within 62 bits), others are numbered.
    """
    if weight <= 0 or tag_weight <= 0:
        raise ValueError("weights must be above 0")
    spark = tokens.sparkSession
    ship(spark)
    whole = ("tinyint", "smallint", "int", "bigint")
    pairs = tokens.select(F.col(item).alias("item"), F.col(token).alias("token")).where("item IS NOT NULL AND token IS NOT NULL")
    kinds = dict(pairs.dtypes)
    names = None if kinds["item"] in whole else _numbers(pairs, "item")
    pairs = pairs.withColumn("x", F.col("item").cast("long")) if names is None else pairs.join(names, "item").withColumnRenamed("number", "x")
    if tags is not None:
        tags = tags.select(F.col(token).alias("token"), F.col(tag).alias("tag"))
        tags = tags.join(_numbers(tags, "tag").withColumnRenamed("number", "tag_id"), "tag").select("token", "tag_id")
    if kinds["token"] in whole:
        number = F.col("token").cast("long")
    else:
        by_name = _numbers(pairs, "token")
        pairs, number = pairs.join(by_name, "token"), F.col("number")
        tags = tags if tags is None else tags.join(by_name, "token")
    pairs = pairs.select(F.shiftleft(number, 1).alias("id"), "x")

    n, entries = pairs.agg(F.count_distinct("x"), F.count("*") * (1 if tags is None else 2)).first()
    blocks = max(1, -(-n // OWN), -(-entries // HELD), min(BLOCKS, -(-n // 250)))
    pairs = pairs.repartition("id").distinct()
    if tags is None:
        pairs = pairs.withColumn("tag", F.lit(-1).cast("long"))
    else:
        tags = stash(tags.select(F.shiftleft(number, 1).alias("id"), (F.shiftleft("tag_id", 1) + 1).alias("tag")).distinct(), "tags")
        pairs = pairs.join(tags, "id", "left").na.fill(-1, ["tag"])
    block = F.pmod(F.xxhash64("x"), F.lit(blocks)).cast("int").alias("block")
    packed = pairs.select(block, "x", "id", "tag").groupBy("block").applyInPandas(_packed, "block int, " + ", ".join(f"{k} binary" for k in _Block.KINDS)).repartitionById(blocks, F.col("block"))
    a, b = (packed.select(*[F.col(c).alias(side + c) for c in packed.columns]) for side in ("a_", "b_"))
    met = a.hint("shuffle_replicate_nl").join(b, F.col("a_block") <= F.col("b_block"))
    found = met.mapInPandas(_best(limit, (float(weight), float(tag_weight)), common), "x long, y long, score double")
    rank = Window.partitionBy("x").orderBy(F.desc("score"), "y")
    best = found.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= limit)
    best = stash(best.withColumn("score", F.col("score").cast("long" if isinstance(weight, int) and isinstance(tag_weight, int) else "double")), "best")
    if names is None:
        return best.select(F.col("x").cast(kinds["item"]).alias("item"), F.col("y").cast(kinds["item"]).alias("other"), "score", "place")
    return best.join(names.withColumnRenamed("number", "x"), "x").join(names.select(F.col("item").alias("other"), F.col("number").alias("y")), "y").select("item", "other", "score", "place")
