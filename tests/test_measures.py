import pytest
from compare import rows
from pyspark.sql import functions as F

from lodestar.operators.measures import (
    RATINGS,
    STOPLIGHT,
    above,
    above_average,
    band,
    include_or_exclude,
    store_display,
    summarize_columns,
    top_n,
    visible_sales,
    what_if_grid,
)
from lodestar.operators.sizing import (
    column_statistics,
    historical_attributes,
    historical_key,
    historical_member_dim,
    historical_member_fact,
    last_n_years,
    latest_start,
)


@pytest.fixture(scope="module")
def groups(spark):
    return spark.createDataFrame([("a", 5), ("b", 9), ("c", 9), ("d", 1), ("e", None)], "g string, m int")


def test_blank_groups_are_dropped(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", 0)], "g string, v int")
    got = summarize_columns(df, ["g"], {"s": F.sum("v"), "m": F.max("v")})
    assert rows(got) == [("a", 1, 1), ("c", 0, 0)]


def test_filters_on_measures(groups):
    assert rows(top_n(groups, "m", 1).select("g")) == [("b",), ("c",)]
    assert rows(top_n(groups, "m", 3).select("g")) == [("a",), ("b",), ("c",)]
    assert rows(above(groups, "m", 5)) == [("b",), ("c",)]
    assert above(groups, "m", 4, hide=False).count() == 3
    assert rows(above_average(groups, "m").select("g")) == [("b",), ("c",)]


def test_optional_exclusion_keeps_nulls(spark):
    df = spark.createDataFrame([("External",), ("In",), (None,)], "place string")
    assert df.filter(include_or_exclude("Yes", "place", "External")).count() == 3
    assert rows(df.filter(include_or_exclude("No", "place", "External"))) == [("In",), (None,)]


def test_what_if_grid(groups):
    grid = what_if_grid(groups.filter("g = 'a'"), "m", 0, 1, 0.01)
    assert grid.count() == 101
    assert rows(grid.filter("parameter = 0.2").select("adjusted")) == [(6.0,)]


def test_bands(groups):
    rated = {r["g"]: (r["label"], r["label_order"]) for r in band(groups, "m", RATINGS, [1, 2, 6, 9]).collect()}
    assert rated == {"a": ("Medium", 2), "b": ("High", 4), "c": ("High", 4), "d": ("Medium-Low", 1), "e": (None, None)}
    with pytest.raises(ValueError, match="bound"):
        band(groups, "m", STOPLIGHT, [1])


def test_stores_and_users(spark):
    stores = spark.createDataFrame([("A",), ("B",), ("C",)], "s string")
    shown = store_display(stores, "s", ["B"]).orderBy("display_sort").collect()
    assert [r["display"] for r in shown] == ["Home Store", "A", "C"]
    sales = spark.createDataFrame([("A", 1), ("A", 2), ("B", 4)], "s string, v int")
    users = spark.createDataFrame([("ma", "A"), ("mb", "B")], "user string, home_store string")

    def total(user, label=None):
        return visible_sales(sales, "s", users, user, label).agg(F.sum("v")).first()[0]

    assert (total("ma"), total("ma", "Home Store"), total("mb", "Home Store")) == (7, 3, 4)
    assert total("ma", "B") == 4 and total("ma", "A") is None
    assert total("nobody") is None and total("nobody", "Home Store") is None


@pytest.fixture(scope="module")
def sales(spark):
    data = [(1, 1, "2018-05-01"), (2, 1, "2020-02-10"), (3, 2, "2019-07-01"), (4, 3, "2020-03-02"), (5, None, "2020-01-01")]
    return spark.createDataFrame(data, "id int, c int, d string").withColumn("d", F.col("d").cast("date"))


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame([(1, "n1", "addr1"), (2, "n2", "addr2"), (3, "n3", "addr3"), (4, "n4", "addr4")], "c int, name string, address string")


def test_historical_key(sales):
    got = historical_key(sales, "id", "d", latest_start(sales, "d", "year"))
    assert {r["id"] for r in got.collect()} == {"Historical Key", "2", "4", "5"}
    assert last_n_years(sales, "d", 1).count() == 4


def test_historical_attributes(sales, customers):
    got = historical_attributes(customers, "c", {"address": "Unknown"}, sales, "c", "d", latest_start(sales, "d", "month"))
    # customer 4 has no sales at all and keeps its address
    assert [r["address"] for r in got.orderBy("c").collect()] == ["Unknown", "Unknown", "addr3", "addr4"]


def test_historical_member(sales, customers):
    cutoff = latest_start(sales, "d", "year")
    fact = historical_member_fact(sales, "c", "d", cutoff)
    dim = historical_member_dim(customers, "c", "name", sales, "c", "d", cutoff)
    assert sorted(r["c"] for r in dim.collect()) == [-1, 1, 3]
    assert dim.filter("c = -1").first()["name"] == "Historical Customer"
    unresolved = fact.filter("c is not null").join(dim, "c", "left_anti")
    assert unresolved.count() == 0
    assert fact.filter("c = -1").count() == 2


def test_column_statistics(sales):
    exact = {r["column"]: r for r in column_statistics(sales, exact=True).collect()}
    assert (exact["c"]["cardinality"], exact["c"]["nulls"], exact["d"]["size"]) == (3, 1, 50)
    assert abs(sum(r["share"] for r in exact.values()) - 1) < 1e-9
    approx = {r["column"]: r for r in column_statistics(sales).collect()}
    assert {k: tuple(v) for k, v in approx.items()} == {k: tuple(v) for k, v in exact.items()}
