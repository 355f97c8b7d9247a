"""Every SQL-checkable query against its SQL twin, on the smallest data set."""

import pytest
from oracle import compare, connect

from emberscope.plans.catalog import QUERIES

CHECKED = sorted(n for n, q in QUERIES.items() if q.sql is not None)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, sf_dir, con, name):
    ok, note = compare(spark, con, QUERIES[name], sf_dir)
    assert ok, note


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(5).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
