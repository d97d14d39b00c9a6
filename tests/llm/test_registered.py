"""Registered queries against their SQL, and schemas of all of them."""

import pytest
from compare import duckdb_over, duckdb_result, spark_result
from conftest import TESTDATA

from usagepulse.llm.queries import llm_oracles, llm_queries

QUERIES, ORACLES = llm_queries(), llm_oracles()


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, len(numbers) + 1))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name, size):
    root = f"{TESTDATA}/{size}"
    assert spark_result(QUERIES[name](spark, root)) == duckdb_result(duckdb_over(root), ORACLES[name])
