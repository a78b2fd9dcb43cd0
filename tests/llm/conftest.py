import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    """The workers of the test session can import the package."""
    from lodestar.llm.shipping import ship_package

    ship_package(spark)
