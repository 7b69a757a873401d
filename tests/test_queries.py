"""All queries against their SQL on the smallest tables."""

import os

import pytest

from check_sql import compare, connect
from tallyspark.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows_as_sql(spark, tables, name):
    assert compare(spark, tables, QUERIES[name], SQL.get(name), SF) is None


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
