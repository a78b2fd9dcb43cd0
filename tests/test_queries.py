"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, difference

from lodestar.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None


@pytest.fixture
def new_york(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield
    spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_in_another_zone(spark, con, new_york, name):
    assert difference(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
