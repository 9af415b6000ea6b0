"""Every registered query against its SQL at the smallest scale."""

import check
import pytest

import __spark_entry__ as entry
from clipstride import catalog

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in catalog.QUERIES)


@pytest.fixture(scope="module")
def database():
    return check.database(SF)


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, database, name):
    same, note = check.compare(entry.queries()[name](spark, SF), database, entry.oracle_sql()[name])
    assert same, note


def test_every_query_has_sql_and_entry_runs(spark):
    assert set(catalog.SQL) == set(catalog.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
