"""Every checked query against the second engine."""

import pytest

from pulsegrain.plans.catalog import load
from tests.compare import compare, connect

ENTRIES = load()


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query(spark, con, small_dir, name):
    entry = ENTRIES[name]
    problem, _rows, _seconds = compare(spark, con, small_dir, name, entry.run, entry.sql)
    assert problem is None


def test_entry_contract(spark):
    import __spark_entry__ as contract
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["date", "active_users", "sessions"]
