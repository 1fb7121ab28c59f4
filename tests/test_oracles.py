"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest

import __spark_entry__ as contract
from catalog.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, connection, name):
    query, sql = contract.queries()[name], contract.oracle_sql().get(name)
    if sql is None:
        assert query(spark, FOLDER).count() > 0
    else:
        assert differences(spark, connection, FOLDER, query, sql) == []


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.count() > 0 and "final_rank" in frame.columns
