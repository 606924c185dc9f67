"""Every registered query with SQL gives what DuckDB gives."""

import pytest

from tests.compare import connect, differences
from thriftline import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert differences(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], SF) == []
