"""Every named query against plain SQL in another engine."""

import pytest

from compare import connect, difference
from vigie.plans import catalog, oracle

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, name):
    assert difference(spark, con, QUERIES[name], SQL[name], SF_DIR) is None
