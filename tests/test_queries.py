"""Every registered query against its SQL at the smallest size."""

import pytest
from compare import connect, difference

from stratalens.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(name, spark, connection):
    assert difference(QUERIES[name](spark, FOLDER), ORACLES[name], connection) is None


def test_entry(spark):
    import __spark_entry__ as entry

    frame = entry.entry(spark)
    assert frame.columns == ["flush", "country", "continent", "drops"] and frame.count() > 0
    assert set(QUERIES) <= set(entry.queries())
