"""Every registered catalog query against its SQL."""

import pytest

from oracle import compare, connection
from tarn.suite.queries import CASES

SF = "/root/testdata/sf0.001"
MAY_BE_EMPTY = {"combine_empty_short_circuit", "filter_starts_with", "filter_contains"}


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("key", sorted(CASES))
def test_equals_sql(spark, con, key):
    case = CASES[key]
    assert case.sql
    assert compare(case.run(spark, SF), case.sql, con) or key in MAY_BE_EMPTY


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
