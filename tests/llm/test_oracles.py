from pathlib import Path

import pytest

from inkloom.llm.oracles import ORACLES
from inkloom.llm.queries import QUERIES
from tests.oracle import DATA, agrees

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    agrees(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0
