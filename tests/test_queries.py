import pytest

from tests.helpers import SF, duck, duck_rows, spark_rows
from trajecta.plans import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_matches_sql(spark, name):
    assert spark_rows(Q.QUERIES[name](spark, SF)) == duck_rows(duck(), Q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_query_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
