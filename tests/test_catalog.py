"""Every registered query against DuckDB on the smallest tables; those without SQL must have rows."""

import pytest

from lakewright.plans import catalog

from .compare import connection, differs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql().get(name)
    if sql:
        assert differs(df, con, sql) == ""
    else:
        assert df.count() > 0
