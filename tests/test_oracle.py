"""Every registered query against its DuckDB oracle on sf0.01 (the driver's correctness gate)."""

from __future__ import annotations

import pytest

from corridor.checks.compare import compare, duck
from corridor.registry import oracle_sql, queries

from .conftest import SF001

QUERIES = queries()
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    res = compare(QUERIES[name](spark, SF001), SQL[name], con)
    assert res["columns_match"], res
    assert res["types_match"], res
    assert res["rows_spark"] == res["rows_oracle"], res
    assert res["match"], res
