"""Queries over surrogate keys, dimensions and smaller models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.joins import join_and_expand
from lodestar.operators.keys import (
    add_surrogate_key,
    build_dimension,
    extend_registry,
    lookup_snapshot_key,
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
from lodestar.queries.registry import Tables, query
from lodestar.sources.staging import stage


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS skey_order FROM orders
""")
def surrogate_key_rows(t: Tables) -> DataFrame:
    """A key per order by date."""
    keyed = add_surrogate_key(
        t.orders.select("o_orderkey", "o_orderdate"), "Order", order=["o_orderdate", "o_orderkey"]
    )
    return keyed.select("o_orderkey", F.col("_SKey Order").alias("skey_order"))


@query("""
SELECT p_partkey, dense_rank() OVER (ORDER BY nullif(p_brand, 'Brand#2') NULLS FIRST, p_type) - 1 AS skey_part
FROM part
""")
def surrogate_key_grouped(t: Tables) -> DataFrame:
    """A key per brand and type; parts without a brand have keys too."""
    parts = t.part.select(
        "p_partkey", F.nullif("p_brand", F.lit("Brand#2")).alias("brand"), "p_type"
    )
    keyed = add_surrogate_key(parts, "Part", ["brand", "p_type"])
    return keyed.select("p_partkey", F.col("_SKey Part").alias("skey_part"))


@query("""
SELECT DISTINCT dense_rank() OVER (ORDER BY p_brand, p_type) - 1 AS skey, p_brand, p_type FROM part
""", name="build_dimension")
def build_dimension_of_parts(t: Tables) -> DataFrame:
    """Brand and type as a dimension, its key checked."""
    keyed = add_surrogate_key(t.part.select("p_brand", "p_type"), "Kind", ["p_brand", "p_type"])
    dim = build_dimension(keyed, "_SKey Kind", ["p_brand", "p_type"])
    return dim.withColumnRenamed("_SKey Kind", "skey")


@query("""
SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey, date_trunc('month', o_orderdate)) - 1 AS skey
FROM orders
""")
def scd_surrogate_lookup(t: Tables) -> DataFrame:
    """Orders get the key of their customer's version of the month."""
    orders = t.orders.select(
        "o_orderkey", "o_custkey", F.to_date(F.date_trunc("month", "o_orderdate")).alias("snapshot"),
        "o_orderpriority",
    )
    versions = orders.groupBy("o_custkey", "snapshot").agg(
        F.max("o_orderpriority").alias("favourite")
    )
    dim = add_surrogate_key(versions, "Customer", order=["o_custkey", "snapshot"])
    keyed = lookup_snapshot_key(orders, dim, ["o_custkey", "snapshot"], "Customer")
    return keyed.select("o_orderkey", F.col("_SKey Customer").alias("skey"))


def _year_before(t: Tables) -> Column:
    """The date a year before the latest order."""
    return t.daily_orders.agg(F.add_months(F.max("day"), -12).alias("cutoff")).scalar()


@query("""
SELECT CASE WHEN o_orderdate < (SELECT date_trunc('year', max(o_orderdate)) FROM orders)
       THEN 'Historical Key' ELSE o_orderkey::VARCHAR END AS o_orderkey, o_totalprice
FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) - INTERVAL 5 YEAR FROM orders)
""", name="historical_key")
def historical_key_of_orders(t: Tables) -> DataFrame:
    """Five years of orders, with their keys in the latest year only."""
    orders = t.daily_orders
    rows = last_n_years(orders, "day", 5)
    keyed = historical_key(rows, "o_orderkey", "day", latest_start(orders, "day", "year"))
    return keyed.select("o_orderkey", "o_totalprice")


@query("""
WITH l AS (SELECT o_custkey, max(o_orderdate) < (SELECT date_trunc('month', max(o_orderdate)) FROM orders) AS old
           FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN old THEN 'Historical' ELSE c_name END AS c_name,
       CASE WHEN old THEN -1 ELSE c_nationkey END AS c_nationkey, c_mktsegment
FROM customer LEFT JOIN l ON c_custkey = o_custkey
""", name="historical_attributes")
def historical_attributes_of_customers(t: Tables) -> DataFrame:
    """Customers without orders in the latest month lose name and nation."""
    dim = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return historical_attributes(
        dim, "c_custkey", {"c_name": "Historical", "c_nationkey": -1},
        t.daily_orders, "o_custkey", "day", latest_start(t.daily_orders, "day", "month"),
    )


@query("""
SELECT c_custkey, c_name, coalesce(c_mktsegment, 'none') AS c_mktsegment FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders
                    WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 1 YEAR FROM orders))
UNION ALL SELECT -1, 'Historical Customer', 'none'
""", name="historical_member_dim")
def historical_member_customers(t: Tables) -> DataFrame:
    """Customers of the last year and one member for all others."""
    dim = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    kept = historical_member_dim(
        dim, "c_custkey", "c_name", t.daily_orders, "o_custkey", "day", _year_before(t)
    )
    return kept.withColumn("c_mktsegment", F.coalesce("c_mktsegment", F.lit("none")))


@query("""
SELECT o_orderkey, CASE WHEN o_orderdate < (SELECT max(o_orderdate) - INTERVAL 1 YEAR FROM orders)
       THEN -1 ELSE o_custkey END AS o_custkey
FROM orders
""", name="historical_member_fact")
def historical_member_orders(t: Tables) -> DataFrame:
    """Older orders point to the historical member."""
    rows = historical_member_fact(t.daily_orders, "o_custkey", "day", _year_before(t))
    return rows.select("o_orderkey", "o_custkey")


@query("""
WITH c AS (SELECT max(o_orderdate) - INTERVAL 1 YEAR AS cutoff FROM orders),
     f AS (SELECT o_custkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS day FROM orders)
SELECT c_custkey, c_name FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM f, c WHERE day IS NULL OR day >= cutoff)
UNION ALL SELECT -1, 'Historical Customer'
""")
def historical_member_without_dates(t: Tables) -> DataFrame:
    """Facts without a date keep their customers."""
    fact = t.daily_orders.withColumn("day", F.when(F.col("o_orderpriority") != "5-LOW", F.col("day")))
    dim = t.customer.select("c_custkey", "c_name")
    return historical_member_dim(dim, "c_custkey", "c_name", fact, "o_custkey", "day", _year_before(t))


_STATS_SQL = """SELECT '{c}' AS "column", count(DISTINCT {v}) AS cardinality,
  count(*) - count({v}) AS nulls, sum(coalesce(strlen({v}::VARCHAR), 0))::BIGINT AS size FROM orders"""

_STATS = {
    "o_orderkey": "o_orderkey",
    "o_custkey": "o_custkey",
    "o_orderstatus": "nullif(o_orderstatus, 'P')",
    "o_orderpriority": "o_orderpriority",
}


@query(f"""
WITH s AS ({" UNION ALL ".join(_STATS_SQL.format(c=c, v=v) for c, v in _STATS.items())})
SELECT *, round(size / (SELECT sum(size) FROM s), 6) AS share FROM s
""", name="column_statistics")
def column_statistics_of_orders(t: Tables) -> DataFrame:
    """Cardinality, nulls and size of columns, counted exactly."""
    rows = t.orders.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    stats = column_statistics(rows, list(_STATS), exact=True)
    return stats.withColumn("share", F.round("share", 6))


@query("""
WITH old AS (SELECT p_brand, p_type, row_number() OVER (ORDER BY p_brand, p_type) - 1 AS key
             FROM (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size <= 5)),
new AS (SELECT DISTINCT p_brand, p_type FROM part WHERE (p_brand, p_type) NOT IN (SELECT (p_brand, p_type) FROM old)),
r AS (FROM old UNION ALL SELECT p_brand, p_type, (SELECT count(*) FROM old) + row_number() OVER (ORDER BY p_brand, p_type) - 1 FROM new)
SELECT p_partkey, key FROM part JOIN r USING (p_brand, p_type)
""")
def surrogate_key_registry(t: Tables) -> DataFrame:
    """Keys of kinds of parts after two loads; the kinds of the first load keep theirs."""
    kind = ["p_brand", "p_type"]
    first = stage(extend_registry(None, t.part.filter("p_size <= 5"), "Kind", kind))
    second = stage(extend_registry(first, t.part, "Kind", kind))
    return join_and_expand(t.part.select("p_partkey", *kind), second, kind, ["_SKey Kind"]).select(
        "p_partkey", F.col("_SKey Kind").alias("key")
    )
