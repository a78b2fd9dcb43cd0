"""Queries over measures by group, filters on measures and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.dates import fiscal_year
from lodestar.functions.measures import distinct_count, divide
from lodestar.operators.logs import object_query_count
from lodestar.operators.measures import (
    RATINGS,
    STOPLIGHT,
    above,
    above_average,
    band,
    count_non_null,
    existing_combinations,
    first_n,
    next_years,
    sum_by_item,
    sum_over_related,
    summarize_columns,
    top_n,
    what_if_grid,
)
from lodestar.operators.ordered import group_rows
from lodestar.operators.quality import equivalence
from lodestar.queries.registry import Tables, cents, iso, query


@query("""
SELECT l_returnflag, round(sum(l_extendedprice), 2) AS sales, round(sum(l_quantity), 2) AS units,
       round(sum(l_extendedprice * l_discount), 2) AS discounts
FROM lineitem GROUP BY l_returnflag
""")
def base_measures(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(
        cents(F.sum("l_extendedprice")).alias("sales"),
        cents(F.sum("l_quantity")).alias("units"),
        cents(F.sum(F.col("l_extendedprice") * F.col("l_discount"))).alias("discounts"),
    )


@query("""
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day,
       count(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END) AS "Count of price"
FROM orders GROUP BY 1 ORDER BY 2 DESC
""")
def count_non_null_by_date(t: Tables) -> DataFrame:
    prices = t.daily_orders.select(
        "day", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price")
    )
    counts = count_non_null(prices, ["day"], "price")
    return counts.withColumn("day", iso("day"))


@query("""
SELECT o_custkey,
       round(coalesce(sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'), 0), 2) AS urgent,
       round(coalesce(sum(o_totalprice) FILTER (o_orderpriority = '5-LOW' AND o_orderstatus = 'P'), 0), 2) AS low
FROM orders GROUP BY o_custkey
HAVING count(*) FILTER (o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus = 'P') > 0
""", name="summarize_columns")
def summarize_columns_of_orders(t: Tables) -> DataFrame:
    """Customers where at least one of two measures is not blank."""
    pending = F.col("o_orderstatus") == "P"

    def total(priority: str) -> Column:
        return F.sum(F.when(pending & (F.col("o_orderpriority") == priority), F.col("o_totalprice")))

    rows = summarize_columns(
        t.orders, ["o_custkey"], {"urgent": total("1-URGENT"), "low": total("5-LOW")}
    )
    zero = F.lit(0.0)
    return rows.select(
        "o_custkey", cents(F.coalesce("urgent", zero)).alias("urgent"),
        cents(F.coalesce("low", zero)).alias("low"),
    )


@query("SELECT DISTINCT p_brand, p_type, p_size FROM part", name="existing_combinations")
def existing_combinations_of_parts(t: Tables) -> DataFrame:
    return existing_combinations(t.part, ["p_brand", "p_type", "p_size"])


_WEIGHT = "(p_size / 100.0) / nullif(p_size - 1, 0)"


def _related_sum(t: Tables) -> DataFrame:
    lines = t.lineitem.select(
        fiscal_year("l_shipdate").alias("fiscal_year"), "l_partkey", "l_extendedprice"
    )
    return sum_over_related(
        lines, ["fiscal_year"], "l_partkey", F.col("l_extendedprice"), t.part, "p_partkey",
        divide(F.col("p_size") / 100.0, F.col("p_size") - 1), "total",
    )


def _item_sum(t: Tables) -> DataFrame:
    # amounts are summed per year and part before the join
    amounts = t.lineitem.groupBy(fiscal_year("l_shipdate").alias("fiscal_year"), "l_partkey").agg(
        F.sum("l_extendedprice").alias("amount")
    )
    rows = amounts.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return sum_by_item(
        rows, ["fiscal_year"], "l_partkey", F.col("amount"),
        F.col("p_size") / 100.0, F.col("p_size") - 1, "total",
    )


_RELATED_SQL = f"""
SELECT year(l_shipdate + INTERVAL 6 MONTH)::INT AS fiscal_year,
       round(sum(l_extendedprice * {_WEIGHT}), 2) AS total
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
"""


@query(_RELATED_SQL)
def sumx_related(t: Tables) -> DataFrame:
    """Line amounts weighted by a ratio of their part; zero divisors give blank."""
    return _related_sum(t).withColumn("total", cents(F.col("total")))


@query(_RELATED_SQL)
def sumx_by_item(t: Tables) -> DataFrame:
    """The same measure in two levels, per part first."""
    return _item_sum(t).withColumn("total", cents(F.col("total")))


@query(f"""
WITH r AS ({_RELATED_SQL})
SELECT count(*) AS rows_left, count(*) AS rows_right, 0::BIGINT AS only_left, 0::BIGINT AS only_right,
       true AS same_schema, true AS equivalent FROM r
""")
def results_equivalent(t: Tables) -> DataFrame:
    """Two forms of a measure give the same rows."""
    return equivalence(
        _related_sum(t).withColumn("total", cents(F.col("total"))),
        _item_sum(t).withColumn("total", cents(F.col("total"))),
    )


@query("""
SELECT o_orderstatus, count(DISTINCT CASE WHEN o_orderpriority = '5-LOW' THEN -1 ELSE o_custkey END) AS n
FROM orders GROUP BY o_orderstatus
""")
def distinct_count_blank(t: Tables) -> DataFrame:
    """Distinct customers, where all orders without one count as one more."""
    thing = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey"))
    return t.orders.groupBy("o_orderstatus").agg(distinct_count(thing).alias("n"))


@query("""
WITH o AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 4
                  AS chunk FROM orders)
SELECT o_custkey, chunk, count(*) AS n,
       string_agg(o_orderkey, ',' ORDER BY o_orderdate, o_orderkey) AS order_keys
FROM o GROUP BY o_custkey, chunk
""", name="group_rows")
def group_rows_of_orders(t: Tables) -> DataFrame:
    """The orders of each customer as nested tables of four, by date."""
    rows = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    nested = group_rows(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], chunk_rows=4)
    keys = F.transform("Group", lambda r: r["o_orderkey"].cast("string"))
    return nested.select(
        "o_custkey", "chunk", F.size("Group").cast("long").alias("n"),
        F.array_join(keys, ",").alias("order_keys"),
    )


@query("""
SELECT event_type AS object, user_id, count(*) AS queries FROM events GROUP BY ALL
""", name="object_query_count")
def object_query_count_of_events(t: Tables) -> DataFrame:
    logs = t.events.withColumnRenamed("event_type", "object")
    return object_query_count(logs, ["object", "user_id"])


@query("""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5
""", name="first_n")
def first_n_orders(t: Tables) -> DataFrame:
    rows = first_n(t.orders, 5, [F.desc("o_totalprice"), F.col("o_orderkey")])
    return rows.select("o_orderkey", "o_totalprice")


@query("""
SELECT p_size, units FROM (SELECT p_size, sum(l_quantity) AS units,
       rank() OVER (ORDER BY sum(l_quantity) DESC) AS place
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_size) WHERE place <= 7
""")
def top_n_by_measure(t: Tables) -> DataFrame:
    """The seven sizes that sold most units, ties included."""
    units = sum_over_related_units(t, "p_size")
    return top_n(units, "units", 7)


def sum_over_related_units(t: Tables, by: str) -> DataFrame:
    """Units per part attribute, summed per part before the join."""
    units = t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("units"))
    rows = units.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(by).agg(F.sum("units").alias("units"))


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 3000000")
def measure_filter_threshold(t: Tables) -> DataFrame:
    """Customers above a constant; the measure is not shown."""
    totals = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return above(totals, "total", 3_000_000)


@query("""
WITH g AS (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey)
SELECT o_custkey, orders FROM g WHERE orders > (SELECT avg(orders) FROM g)
""")
def measure_filter_above_avg(t: Tables) -> DataFrame:
    """Customers with more orders than the average customer."""
    counts = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    return above_average(counts, "orders")


@query("""
SELECT p_brand, round(s / 100.0, 2) AS parameter, round(units * (1 + s / 100.0), 4) AS adjusted
FROM (SELECT p_brand, sum(l_quantity) AS units FROM lineitem JOIN part ON l_partkey = p_partkey
      GROUP BY p_brand), generate_series(0, 100, 5) AS g(s)
""", name="what_if_grid")
def what_if_grid_of_brands(t: Tables) -> DataFrame:
    """Units per brand under a percentage from 0 to 1 in steps of 0.05."""
    grid = what_if_grid(sum_over_related_units(t, "p_brand"), "units", 0, 1, 0.05)
    return grid.select(
        "p_brand", F.round("parameter", 2).alias("parameter"), F.round("adjusted", 4).alias("adjusted")
    )


_BRAND_SQL = """
SELECT p_brand, sum(p_size) / count(*) AS size FROM part GROUP BY p_brand
"""


def _brand_sizes(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(
        (F.sum("p_size") / F.count(F.lit(1))).alias("size")
    )


@query(f"""
SELECT p_brand, 'Red' AS label, 3 AS label_order FROM ({_BRAND_SQL}) WHERE size >= 25.5
""")
def stoplight_filter(t: Tables) -> DataFrame:
    """Brands whose mean size shows red."""
    shown = band(_brand_sizes(t), "size", STOPLIGHT, [24.5, 25.5])
    return shown.filter(F.col("label") == "Red").select("p_brand", "label", "label_order")


@query("""
SELECT c_custkey,
  CASE WHEN c_acctbal >= 7500 THEN 'High' WHEN c_acctbal >= 5000 THEN 'Medium-High'
       WHEN c_acctbal >= 2500 THEN 'Medium' WHEN c_acctbal >= 0 THEN 'Medium-Low' ELSE 'Low' END AS label,
  CASE WHEN c_acctbal >= 7500 THEN 4 WHEN c_acctbal >= 5000 THEN 3
       WHEN c_acctbal >= 2500 THEN 2 WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS label_order
FROM customer
""")
def rating_bands(t: Tables) -> DataFrame:
    """Customers rated by balance, sorted by the order of the rating."""
    rated = band(t.customer, "c_acctbal", RATINGS, [0, 2500, 5000, 7500])
    return rated.select("c_custkey", "label", "label_order").orderBy("label_order")


@query("""
SELECT year(o_orderdate + INTERVAL 6 MONTH)::INT AS fiscal_year, round(sum(o_totalprice), 2) AS total
FROM orders WHERE year(o_orderdate + INTERVAL 6 MONTH) BETWEEN 1997 AND 1999 GROUP BY 1
""")
def next_n_years(t: Tables) -> DataFrame:
    """The three fiscal years after the selected one."""
    rows = next_years(
        t.orders.withColumn("fiscal_year", fiscal_year("o_orderdate")), "fiscal_year", 1996, 3
    )
    return rows.groupBy("fiscal_year").agg(cents(F.sum("o_totalprice")).alias("total"))
