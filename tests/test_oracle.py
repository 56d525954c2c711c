"""Cross-engine check of every registered key (the driver's gate, here at sf0.001)."""

import pytest

from conftest import SF_SMALL
from ledgerframe.plans.registry import ORACLE, QUERIES, load_all
from ledgerframe.verify import compare, duck_connect

load_all()


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_key_matches_duckdb(spark, con, key):
    res = compare(key, QUERIES[key](spark, SF_SMALL), ORACLE[key], con)
    assert res.ok, res.summary()
