import pytest

from holdfast import catalog
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    compare(spark, catalog.queries()[name], SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0
