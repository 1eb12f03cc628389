"""Every query with a SQL twin gives the same rows as DuckDB, bit by bit."""

import pytest

import __spark_entry__ as entry_module
from checks import QUERIES, TWINS
from checks.compare import connect, difference, spark_rows, sql_rows
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, duck, name):
    assert difference(spark_rows(QUERIES[name](spark, SMALL)), sql_rows(duck, TWINS[name])) is None


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_the_comparison_notices():
    wanted = (["a"], ["int"], [(1,), (2,)])
    assert difference((["a"], ["int"], [(2,), (1,)]), wanted) is None
    for other in ((["b"], *wanted[1:]), (["a"], ["double"], wanted[2]), (["a"], ["int"], [(1,)]), (["a"], ["int"], [(1,), (3,)])):
        assert difference(other, wanted)
