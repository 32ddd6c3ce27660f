import pytest

import waymark.plan_queries  # noqa: F401
import waymark.road_queries  # noqa: F401
import waymark.score_queries  # noqa: F401
import waymark.study_queries  # noqa: F401
from tests.oracle import compare
from waymark.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    compare(spark, sf, QUERIES[name], ORACLES[name])
