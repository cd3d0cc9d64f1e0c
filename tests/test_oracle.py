"""Every registered query against its SQL on the same files."""

import pytest

import __spark_entry__ as contract
from tests.compare import differences, duck

FOLDER = "/root/testdata/sf0.01"
QUERIES = contract.queries()
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    frame = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert differences(frame, connection, ORACLES[name]) is None
    else:
        assert frame.count() > 0


def test_entry(spark):
    assert contract.entry(spark).columns == ["date", "conversations", "messages"]
