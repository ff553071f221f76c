from pathlib import Path

import pytest

from inkloom.plans.catalogue import ORACLES, QUERIES, flagship
from tests.oracle import DATA, agrees

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    agrees(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    QUERIES[name](spark, DATA).write.format("noop").mode("overwrite").save()


def test_flagship(spark):
    assert flagship(spark, DATA).count() > 0
