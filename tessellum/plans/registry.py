"""The registered queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
PARTS = ("documents", "exposure", "ordered", "statistics", "graphs", "spatial", "joins", "quality", "texts", "gate", "routing", "profiles", "layers", "features", "outlines", "masks", "slopes", "rules", "terrain")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name."""

    def put(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql.strip()
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for part in PARTS:
        importlib.import_module(f"tessellum.plans.{part}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _queries["related_items"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
