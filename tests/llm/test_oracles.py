import pytest

from tests.oracle import compare
from waymark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    compare(spark, sf, QUERIES[name], ORACLES[name])
