"""Every registered query against its SQL counterpart on the smallest tables."""

from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.parity import connect, differences

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, connection, name):
    ours = queries()[name](spark, FOLDER).toPandas()
    assert len(ours), "a query without rows checks nothing"
    assert differences(ours, connection.execute(oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert entry(spark).columns == ["batch_id", "view", "pos", "input_id", "label"]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
