"""Every query that has SQL returns the SQL's rows."""

import pytest

import oracle
from lakeloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, name):
    assert oracle.same(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name]) == ""


def test_rows_only(spark):
    assert registry.queries()["snippet"](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10 and set(e.oracle_sql()) <= set(e.queries())
