"""Queries over data-quality tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.quality import (
    Check,
    check_report,
    differences,
    many_values,
    null_counts,
    repeated,
    require_in_plan,
)
from lodestar.queries.registry import Tables, query


@query("""
SELECT l_returnflag, count(*) AS lines FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY 1
""")
def dq_condition(t: Tables) -> DataFrame:
    """Lines counted behind a test that fails the job when it is broken."""
    quantity = F.col("l_quantity").cast("string")
    lines = require_in_plan(
        t.lineitem, F.col("l_quantity").between(1, 50),
        F.concat(F.lit("quantity out of range: "), quantity),
    )
    return lines.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("lines"))


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1
""")
def dq_unique_key(t: Tables) -> DataFrame:
    """Line keys that occur more than once."""
    return repeated(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("""
SELECT p_name, count(DISTINCT p_brand) AS n FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1
""")
def dq_functional_dependency(t: Tables) -> DataFrame:
    """Part names that stand for several brands."""
    return many_values(t.part, ["p_name"], "p_brand")


@query("""
SELECT 'o_orderkey' AS "column", count(*) - count(o_orderkey) AS nulls FROM orders
UNION ALL SELECT 'o_orderstatus', count(*) - count(nullif(o_orderstatus, 'P')) FROM orders
UNION ALL SELECT 'o_totalprice', count(*) - count(o_totalprice) FROM orders
""")
def dq_not_null(t: Tables) -> DataFrame:
    """Nulls per column of orders, pending ones taken as missing."""
    rows = t.orders.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return null_counts(rows, ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("""
WITH c AS (SELECT count(*) AS rows, count_if(l_quantity < 1)::BIGINT AS a, count_if(l_discount >= 0.1)::BIGINT AS b,
                  count_if(l_shipdate < DATE '1995-06-01')::BIGINT AS c,
                  count_if(l_tax > 1)::BIGINT AS d FROM lineitem)
SELECT 0 AS position, 'quantity' AS "check", 'abort' AS failure_mode, rows, a AS violations,
       CASE WHEN a = 0 THEN 'passed' ELSE 'failed' END AS outcome FROM c
UNION ALL SELECT 1, 'discount', 'continue', rows, b, CASE WHEN b = 0 THEN 'passed' ELSE 'warning' END FROM c
UNION ALL SELECT 2, 'shipped', 'skip', rows, c, CASE WHEN c = 0 THEN 'passed' ELSE 'failed' END FROM c
UNION ALL SELECT 3, 'tax', 'abort', rows, d,
       CASE WHEN c > 0 THEN 'skipped' WHEN d = 0 THEN 'passed' ELSE 'failed' END FROM c
""")
def dq_suite(t: Tables) -> DataFrame:
    """Four tests with their failure modes in one pass."""
    return check_report(
        t.lineitem,
        [
            Check("quantity", F.col("l_quantity") >= 1),
            Check("discount", F.col("l_discount") < 0.1, "continue"),
            Check("shipped", F.col("l_shipdate") >= F.lit("1995-06-01").cast("timestamp_ntz"), "skip"),
            Check("tax", F.col("l_tax") <= 1),
        ],
    )


@query("""
WITH a AS (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders),
b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 500 = 0 THEN 'changed' ELSE o_orderpriority END AS o_orderpriority
      FROM orders WHERE o_orderkey % 700 <> 0 UNION ALL SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 900 = 0),
x AS ((FROM a EXCEPT ALL FROM b)), y AS ((FROM b EXCEPT ALL FROM a))
SELECT *, 'left' AS only_in, count(*) AS times FROM x GROUP BY ALL
UNION ALL SELECT *, 'right', count(*) FROM y GROUP BY ALL
""")
def result_differences(t: Tables) -> DataFrame:
    """Orders against a copy with some rows changed, dropped or doubled."""
    keys = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    changed = F.when(F.col("o_orderkey") % 500 == 0, "changed").otherwise(F.col("o_orderpriority"))
    other = keys.filter("o_orderkey % 700 <> 0").withColumn("o_orderpriority", changed).unionByName(
        keys.filter("o_orderkey % 900 = 0")
    )
    return differences(keys, other, samples=None)
