import pytest


@pytest.fixture(scope="module")
def spark_shared(spark):
    return spark
