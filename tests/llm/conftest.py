import pytest

from reqlens.llm import common


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    common.ship_package(spark)
