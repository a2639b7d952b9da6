import pytest

import __spark_entry__ as entry
from tests.parity import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def engine():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, engine, name):
    result = compare(spark, engine, name, QUERIES, SQL, FOLDER)
    assert result["status"] == "ok", result


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)
