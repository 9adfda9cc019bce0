import pytest

from brolga.llm.registry import ORACLES, QUERIES
from tests.sqlcheck import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    same(spark, sf, QUERIES[name], ORACLES[name])
