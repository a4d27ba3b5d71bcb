"""Every query against its SQL twin on the whole sf0.01 tables."""

import pytest

import __spark_entry__ as entry
import checks.oracles
import checks.queries
from tests.compare import connect, mismatch

QUERIES = checks.queries.queries()
SQL = checks.oracles.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, con, name):
    assert mismatch(QUERIES[name](spark, sf), con, SQL[name]) is None


def test_flagship(spark):
    assert entry.entry(spark).count() == 3
