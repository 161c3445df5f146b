import pytest

from kinspan import catalog
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_sql_twin(spark, connection, name):
    assert oracle.compare(spark, connection, catalog.QUERIES[name], catalog.ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_twin_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
