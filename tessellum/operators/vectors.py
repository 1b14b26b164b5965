"""Nearest vectors by exact comparison, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.plans.stages import ship

#: Numbers in a block of rows or of queries, and distances looked at together.
BLOCK, TILE = 1_000_000, 4_000_000


def _matrix(listed: pd.Series, dim: int) -> np.ndarray:
    """One row a vector; what isn't a vector of the common length is unknown throughout."""
    out = np.full((len(listed), dim), np.nan)
    for i, v in enumerate(listed):
        if v is not None and len(v) == dim:
            out[i] = np.asarray(v, dtype="float64")
    return out + 0.0  # -0.0 is 0.0


def _least(block: pd.DataFrame) -> pd.DataFrame:
    """For each query of a block the nearest of its rows, by sums in the order of the numbers, the least id on ties, unknown distances last."""
    dim = int(block["dim"].iloc[0])
    asked, rows = block[block["asked"]], block[~block["asked"]].drop_duplicates("id").sort_values("id")
    got: list[tuple[int, float, int]] = []
    if len(asked) and len(rows):
        ids, m = rows["id"].to_numpy(), _matrix(rows["v"], dim)
        # equal vectors count once, by their two least ids
        kinds, first, kind = np.unique(np.ascontiguousarray(m).view(f"V{8 * dim}").ravel(), return_index=True, return_inverse=True)
        second = np.full(len(kinds), -1)
        later = np.setdiff1d(np.arange(len(ids)), first)
        second[kind[later][::-1]] = later[::-1]
        v, vv = m[first], (m[first] ** 2).sum(axis=1)
        most = np.nanmax(vv, initial=0.0)
        q_ids, q_all = asked["id"].to_numpy(), _matrix(asked["v"], dim)
        step = max(1, TILE // len(kinds))
        for at in range(0, len(q_ids), step):
            qid, q = q_ids[at : at + step], q_all[at : at + step]
            qq = (q**2).sum(axis=1)
            with np.errstate(all="ignore"):
                about = qq[:, None] + vv[None, :] - 2 * (q @ v.T)
                alone = (ids[first][None, :] == qid[:, None]) & (second[None, :] < 0)
                about[alone] = np.inf
                slack = 1e-13 * dim * (qq + most)
                least = np.fmin.reduce(about, axis=1) + slack
                i, j = np.nonzero(((about <= least[:, None]) | np.isnan(about) | np.isnan(least)[:, None]) & ~alone)
                # only these are compared exactly
                for a in range(0, len(i), TILE):
                    x, y = i[a : a + TILE], j[a : a + TILE]
                    d = np.zeros(len(x))
                    for n in range(dim):
                        d += (q[x, n] - v[y, n]) ** 2
                    other = np.where(ids[first][y] == qid[x], ids[second[y]], ids[first][y])
                    order = np.lexsort((other, d, x))
                    _, head = np.unique(x[order], return_index=True)
                    got += zip(qid[x[order][head]].tolist(), d[order][head].tolist(), other[order][head].tolist(), strict=True)
    return pd.DataFrame(got, columns=["qid", "d", "other"]).astype({"qid": "int64", "d": "float64", "other": "int64"})


def nearest_vectors(vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, other): for each of ``asked`` (id, v) the nearest of ``vectors`` (id, v) with another id, by the sum of squared differences; the least id on ties.

    Every block of queries meets every block of rows in one task as matrices, which tell what can't be nearest; the rest is compared number by number. A block has ``BLOCK`` numbers,
    whatever the sizes of both tables; the work is queries times rows. Ids are never negative.
    """
    spark = vectors.sparkSession
    ship(spark)
    seen = vectors.agg(F.count("*").alias("n"), F.mode(F.size("v")).alias("dim")).first()
    dim = max(seen["dim"] or 1, 1)
    each = max(1, BLOCK // dim)
    blocks, chunks = -(-asked.count() // each) or 1, -(-seen["n"] // each) or 1
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.select("id", "v", F.lit(False).alias("asked"), deal(chunks).alias("chunk")).withColumn("block", every(blocks))
    queries = asked.select("id", "v", F.lit(True).alias("asked"), every(chunks).alias("chunk")).withColumn("block", deal(blocks))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    both = rows.unionByName(queries).withColumn("dim", F.lit(dim)).repartition(parts, "block", "chunk")
    best = both.groupBy("block", "chunk").applyInPandas(_least, "qid long, d double, other long").groupBy("qid").agg(F.min(F.struct("d", "other")).alias("m"))
    return best.select(F.col("qid").alias("id"), F.col("m.other").alias("other"))
