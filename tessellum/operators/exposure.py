"""Exposure analytics: conditional sums over groups, tiers and scenarios, allocation and proportional fitting."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.plans.stages import stash


def mask_sums(values: dict[str, Column], masks: dict[str, Column]) -> list[Column]:
    """A conditional sum of every value under every mask, named ``<value>_<mask>``; no row under a mask gives 0."""
    return [F.coalesce(F.sum(F.when(m, v)), F.lit(0)).alias(f"{vn}_{mn}") for mn, m in masks.items() for vn, v in values.items()]


def tier_of(code: Column, bounds: list[float]) -> Column:
    """How many of the rising bounds the value reaches: 0 below the first."""
    return sum((F.when(code >= b, 1).otherwise(0) for b in bounds), F.lit(0))


def tier_cube(df: DataFrame, *, by: list[str], tier: str, measures: dict[str, Column], any_name: str = "any") -> DataFrame:
    """``by``, tier as text, measures; and a row ``any`` over the tiers above 0. One shuffle: tiers are summed first."""
    cells = df.groupBy(*by, tier).agg(*[m.alias(n) for n, m in measures.items()])
    above = cells.where(F.col(tier) > 0).groupBy(*by).agg(*[F.sum(n).alias(n) for n in measures])
    return cells.withColumn(tier, F.col(tier).cast("string")).unionByName(above.withColumn(tier, F.lit(any_name)))


def scenario_grid(spark, **axes: list) -> DataFrame:
    """All combinations of a few literal values, made here: their number is the product of the lists, and crossing tables would take a task for each pair of their partitions."""
    return F.broadcast(spark.createDataFrame(list(product(*axes.values())), list(axes)))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Null where the weights sum to nothing; rows without value or weight are left out."""
    held = value.isNotNull() & weight.isNotNull()
    return F.sum(F.when(held, value * weight)) / F.nullif(F.sum(F.when(held, weight)), F.lit(0.0))


def share_of(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percent, null where the whole is 0."""
    return F.round(100 * part / F.nullif(whole, F.lit(0)), digits)


def allocate(df: DataFrame, *, group: str, total: str, weight: str, name: str = "allocated") -> DataFrame:
    """A group's total spread over its rows by weight; a group without weight keeps null."""
    own = Window.partitionBy(group)
    return df.withColumn(name, F.col(total) * F.col(weight) / F.nullif(F.sum(weight).over(own), F.lit(0.0)))


def merge_hidden(df: DataFrame, *, key: str, receiver: str, values: list[str], label: str) -> DataFrame:
    """Rows merged into their receiver (themselves if none): sums of the values, and the merged labels sorted."""
    to = F.coalesce(F.col(receiver), F.col(key))
    return df.groupBy(to.alias(key)).agg(*[F.sum(v).alias(v) for v in values], F.array_join(F.sort_array(F.collect_list(F.when(F.col(receiver).isNotNull(), F.col(label)))), ";").alias("merged"))


def proportional_fit(cells: DataFrame, margins: list[tuple[str, DataFrame, str]], *, value: str = "v", rounds: int = 200, tolerance: float = 0.01) -> DataFrame:
    """Iterative proportional fitting: ``value`` scaled to each margin (key, table, total) in turn until no sum is off by the tolerance.

    Sums go through partial aggregates, so a key with many cells is no bottleneck; the lineage is cut every
    round, since each step reads the one before twice, and one number a round comes to the driver. Cells of a key whose sum is 0 stay as they are.
    """
    keys = [k for k, _, _ in margins]
    now = stash(cells.select(*keys, F.col(value).cast("double").alias("v")), "cells")
    for i in range(1, rounds + 1):
        for key, table, total in margins:
            sums = now.groupBy(key).agg(F.sum("v").alias("s"))
            scale = sums.join(table.select(F.col(key), F.col(total).alias("t")), key).select(key, F.when(F.col("s") > 0, F.col("t") / F.col("s")).otherwise(1.0).alias("x"))
            now = now.join(scale, key, "left").select(*keys, (F.col("v") * F.coalesce("x", F.lit(1.0))).alias("v"))
        now = stash(now, "cells")
        off = 0.0
        for key, table, total in margins if i < rounds else []:
            sums = now.groupBy(key).agg(F.sum("v").alias("s")).join(table.select(F.col(key), F.col(total).alias("t")), key)
            off = max(off, sums.agg(F.max(F.abs(F.col("s") - F.col("t")))).first()[0] or 0.0)
        if off < tolerance:
            break
    return now.withColumnRenamed("v", value)


def top_weighted(df: DataFrame, *, by: str, weight: Column, limit: int) -> DataFrame:
    return df.groupBy(by).agg(F.sum(weight).alias("total")).orderBy(F.desc("total"), by).limit(limit)


def majority(df: DataFrame, *, by: str, code: str, weight: Column, least_share: float = 0.0) -> DataFrame:
    """(by, code, share): the code of most weight, the smaller on ties; null if its share is below the least."""
    votes = df.groupBy(by, code).agg(F.sum(weight).alias("w"))
    best = votes.groupBy(by).agg(F.max(F.struct(F.col("w"), (-F.col(code)).alias("c"))).alias("m"), F.sum("w").alias("all"))
    share = F.col("m.w") / F.col("all")
    return best.select(by, F.when(share >= least_share, -F.col("m.c")).alias(code), share.alias("share"))
