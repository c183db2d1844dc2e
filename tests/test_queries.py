"""Every query of the library beside its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from brontide.plans import all_queries, all_sql

from .compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, SF, all_queries()[name], all_sql()[name]) == ""


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(all_queries()) <= set(entry.queries())
