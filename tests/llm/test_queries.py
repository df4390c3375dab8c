"""Registered queries against their SQL; the rest are compared with brute force elsewhere."""

import pytest

from fieldtempo.llm.entries import oracle_sql, queries
from tests.oracle_compare import connect, differences, duckdb_rows, spark_rows


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    result = spark_rows(queries()[name](spark, folder))
    assert differences(result, duckdb_rows(connect(folder), oracle_sql()[name])) == []


def test_every_operator_and_the_pipeline_are_registered():
    names = {name.split("_")[0] for name in queries()}
    assert names == {f"op{n}" for n in range(1, 14)} | {"pipeline"}
