"""Every registered query of the library runs; those with SQL equal DuckDB's result."""

from __future__ import annotations

import pytest

from larkspur.plans import registry
from tests.oracle import assert_same, connection

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, data, con):
    assert_same(QUERIES[name](spark, data).toPandas(), con.execute(SQL[name]).fetchdf())


def test_every_query_is_compared():
    """What has no SQL is compared in tests/test_brute.py."""
    from pathlib import Path

    brute = (Path(__file__).parent / "test_brute.py").read_text()
    assert not [n for n in set(QUERIES) - set(SQL) if f'"{n}"' not in brute]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["qid", "id", "score", "rank", "bm25_rank", "vector_rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
