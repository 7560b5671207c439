"""Every registered query against its DuckDB twin at the smallest scale."""

import pytest
from check import compare, connect

from batchloom.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES.get(name), SF) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
