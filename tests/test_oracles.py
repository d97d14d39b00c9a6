"""Every registered query against its oracle, values and types."""

import pytest

import __spark_entry__
from compare import duckdb_over, duckdb_result, spark_result
from conftest import TESTDATA

from usagepulse.plans.oracle import all_oracles
from usagepulse.plans.queries import all_queries

QUERIES = all_queries()
ORACLES = all_oracles()
SPARK_TYPES = {
    "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "INTEGER": "int",
}


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def tables(request):
    root = f"{TESTDATA}/{request.param}"
    return root, duckdb_over(root)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, tables, name):
    root, connection = tables
    result = QUERIES[name](spark, root)
    assert spark_result(result) == duckdb_result(connection, ORACLES[name])
    described = connection.execute(f"DESCRIBE {ORACLES[name]}").fetchall()
    expected = {row[0]: SPARK_TYPES[str(row[1])] for row in described}
    assert {f.name: f.dataType.simpleString() for f in result.schema} == expected


def test_entry_registers_them_all():
    assert QUERIES.keys() <= __spark_entry__.queries().keys()
    assert ORACLES.keys() <= __spark_entry__.oracle_sql().keys()


def test_entry_returns_one_row(spark):
    assert __spark_entry__.entry(spark).count() == 1
