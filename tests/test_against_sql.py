"""Every query with reference SQL gives the same rows on a small table set."""

from __future__ import annotations

import pytest

from gaugelab.catalog import ORACLES, QUERIES
from tests.conftest import SMALL_DIR
from tests.oracle_check import connect, difference


@pytest.fixture(scope="session")
def con():
    return connect(SMALL_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SMALL_DIR).toPandas()
    assert difference(got, con.execute(ORACLES[name]).df()) is None


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
