import __spark_entry__ as entry
import pytest

from quillgrove.plans import catalogue
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, small, duck, name):
    same(catalogue.QUERIES[name](spark, small), duck, catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
