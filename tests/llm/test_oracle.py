import pytest

from tessellum.llm import queries

from ..oracle import compare


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert compare(spark, name, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.001") is None
