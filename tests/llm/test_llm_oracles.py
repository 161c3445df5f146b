import pytest

from kinspan.llm import queries
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql_twin(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF) is None


def test_pipeline_runs_through_all_stages(spark):
    out = queries.pipeline(spark, SF).collect()
    assert out and {"doc_id", "sequence_id", "offset", "length"} <= set(out[0].asDict())
    assert all(0 < r["length"] <= 1024 for r in out)
