"""The DataFrame derivation of each ERP test table equals its DuckDB text (FIXTURES.md)."""

import pytest

from conftest import SF_SMALL
from ledgerframe.plans.fixtures_sql import FIXTURE_SQL
from ledgerframe.sources.demo import erp_tables
from ledgerframe.verify import compare, duck_connect


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(FIXTURE_SQL))
def test_fixture_table_matches_duckdb(spark, con, name):
    df = erp_tables(spark, SF_SMALL)[name]
    res = compare(name, df, FIXTURE_SQL[name], con)
    assert res.ok, res.summary()
