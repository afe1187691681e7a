"""Every query with oracle SQL must equal DuckDB at sf0.01 (columns, rows, values)."""

import pytest

from helpers import SF01
from oracle import compare, duck
from sparkrisk.plans import model_queries  # noqa: F401  (registers model queries)
from sparkrisk.plans.registry import ORACLE_SQL


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, con, name):
    r = compare(spark, con, name, SF01)
    assert r["cols_match"], r
    assert r["rows_match"], r
    assert r["hash_match"], r
