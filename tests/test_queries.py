"""Every registered query against its SQL in an independent engine."""

import pytest

from __spark_entry__ import entry
from offramp.plans.catalog import QUERIES
from offramp.plans.oracle import ORACLE
from tests.oracle_check import check, connect


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, small, name):
    assert check(spark, con, name, small) is None


def test_entry(spark):
    rows = entry(spark).collect()
    assert sorted(r["exit_layer"] for r in rows) == [16, 32, 48, 64]
