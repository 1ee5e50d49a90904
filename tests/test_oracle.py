import pytest
from compare import connection, rows_of_spark, rows_of_sql

from cairn import plans


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    assert rows_of_spark(plans.QUERIES[name](spark, sf)) == rows_of_sql(con, plans.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0
