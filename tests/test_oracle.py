"""Every registered query against its SQL, and the others for rows."""

import pytest

from tessellum.plans import registry

from .oracle import compare

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: No row at this size, for which the larger tables are used.
SPARSE = {"alternative_paths"}
#: Nothing to route between at this size: tests/test_plain.py looks at these on a network of its own.
EMPTY = {"penalty_routes", "plateau_routes", "plateau_edges"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    assert compare(spark, name, QUERIES[name], SQL[name], SF.replace("0.001", "0.01") if name in SPARSE else SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows or name in EMPTY


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_components_by_union_find(spark):
    up: dict[int, int] = {}

    def top(x: int) -> int:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    owner = {r.o_orderkey: r.o_custkey for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        a, b = sorted((top(owner[r.l_orderkey]), top(-1 - r.l_partkey)))
        up[b] = a
    got = {r.node: r.component for r in QUERIES["components"](spark, SF).collect()}
    assert got == {n: top(n) for n in up}
    sizes: dict[int, int] = {}
    for c in got.values():
        sizes[c] = sizes.get(c, 0) + 1
    best = min(c for c, n in sizes.items() if n == max(sizes.values()))
    assert {r.node for r in QUERIES["largest_component"](spark, SF).collect()} == {n for n, c in got.items() if c == best}
