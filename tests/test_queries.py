"""Every registered query next to its SQL over the smallest tables."""

import pytest

from newsmill.suite import ORACLES, QUERIES
from newsmill.suite.check import compare, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    ok, text = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf)
    assert ok, text


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
