"""Every registered query against its SQL at the smallest scale."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, queries()[name], SQL[name], SF) == []


def test_queries_without_sql_are_corpus_operators():
    """Those are held against plain Python in tests/llm."""
    assert {name for name in queries() if name not in SQL} <= {name for name in queries() if name == "pipeline" or name.startswith("op")}


def test_entry(spark):
    assert entry(spark).columns == ["pos", "label", "value"]
    assert entry(spark).count() > 0
