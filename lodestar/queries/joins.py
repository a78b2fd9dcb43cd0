"""Queries over joins, filter propagation and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.joins import (
    Dimension,
    Filter,
    FilterContext,
    RowIntegrity,
    Star,
    cascade_match,
    join_and_expand,
    not_in_model,
    reduce_bridge,
    through_bridge,
    values_in_use,
)
from lodestar.operators.measures import home_store_sales, store_display, visible_sales
from lodestar.queries.registry import Tables, cents, query


@query("""
SELECT o_orderkey, coalesce(c_name, 'none') AS c_name, coalesce(c_mktsegment, 'none') AS c_mktsegment
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey
""")
def join_expand(t: Tables) -> DataFrame:
    """Customers with a positive balance joined to all orders."""
    joined = join_and_expand(
        t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")),
        t.customer.filter("c_acctbal > 0"), ["c_custkey"], ["c_name", "c_mktsegment"],
    )
    return joined.select(
        "o_orderkey",
        F.coalesce("c_name", F.lit("none")).alias("c_name"),
        F.coalesce("c_mktsegment", F.lit("none")).alias("c_mktsegment"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
""")
def join_expand_checked(t: Tables) -> DataFrame:
    """Order priority on every line; the check passes as order keys are unique."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return join_and_expand(
        lines, t.orders, ["l_orderkey"], ["o_orderpriority"],
        target_on=["o_orderkey"], integrity=RowIntegrity.CHECKED,
    )


@query("""
WITH s AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, c_name FROM customer),
f AS (SELECT segment, arg_min(c_name, c_custkey) AS first_name FROM s GROUP BY segment)
SELECT c_custkey, coalesce(s.segment, 'none') AS segment, first_name
FROM s LEFT JOIN f ON s.segment IS NOT DISTINCT FROM f.segment
""")
def join_expand_dedup(t: Tables) -> DataFrame:
    """First customer of each segment; the null segment matches the null segment."""
    rows = t.customer.select(
        "c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), "c_name"
    )
    joined = join_and_expand(
        rows.select("c_custkey", "segment"), rows, ["segment"], ["c_name"],
        integrity=RowIntegrity.DISTINCT_TARGET, expand_as=["first_name"], first_by=["c_custkey"],
    )
    return joined.withColumn("segment", F.coalesce("segment", F.lit("none")))


@query("""
SELECT l_orderkey, l_linenumber, p_name AS item, p_brand AS brand
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
""")
def join_expand_renamed(t: Tables) -> DataFrame:
    joined = join_and_expand(
        t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), t.part,
        ["l_partkey"], ["p_name", "p_brand"],
        target_on=["p_partkey"], expand_as=["item", "brand"],
    )
    return joined.drop("l_partkey")


@query("""
WITH bridge AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'
                AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))
SELECT b.o_orderpriority AS priority, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total
FROM orders o JOIN bridge b ON o.o_custkey = b.o_custkey GROUP BY 1
""")
def bridge_semi_join(t: Tables) -> DataFrame:
    """Orders of a segment by the priorities its customers have finished orders in."""
    bridge = t.orders.filter("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority")
    ).distinct()
    builders = t.customer.filter("c_mktsegment = 'BUILDING'")
    bridge = reduce_bridge(bridge, "customer", builders, "c_custkey")
    # orders are summed per customer first: one row per customer crosses the bridge
    sums = t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total")
    )
    rows = through_bridge(sums, "o_custkey", bridge, "customer", "priority")
    return rows.groupBy("priority").agg(
        F.sum("orders").alias("orders"), cents(F.sum("total")).alias("total")
    )


@query("""
SELECT p_partkey, p_brand FROM part
WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48)
""")
def slicer_valid_values(t: Tables) -> DataFrame:
    """Parts that still have lines under the other slicers' filters."""
    lines = t.lineitem.filter("l_returnflag = 'R' AND l_quantity >= 48")
    return values_in_use(t.part, "p_partkey", lines, "l_partkey").select("p_partkey", "p_brand")


@query("""
SELECT h AS home_store, s_name AS store,
       CASE WHEN h = s_name THEN 'Home Store' ELSE s_name END AS display,
       CASE WHEN h = s_name THEN '' ELSE s_name END AS display_sort
FROM supplier, (VALUES ('Supplier#000000003'), ('Supplier#000000007')) AS homes(h)
""")
def home_store_display(t: Tables) -> DataFrame:
    """All suppliers as stores, seen from two home stores."""
    return store_display(t.supplier, "s_name", ["Supplier#000000003", "Supplier#000000007"])


def _store_orders(t: Tables) -> DataFrame:
    """Orders summed per customer, with the nation of the customer as the store."""
    places = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    places = places.select("c_custkey", F.col("n_name").alias("store"))
    sums = t.orders.groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("orders")
    )
    return sums.join(places, F.col("o_custkey") == F.col("c_custkey"))


def _store_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("store").agg(
        cents(F.sum("total")).alias("total"), F.sum("orders").alias("orders")
    )


def _users(t: Tables) -> DataFrame:
    """Suppliers as users, their nation as home store."""
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("s_name").alias("user"), F.col("n_name").alias("home_store"))


@query("""
WITH sales AS (SELECT c_nationkey AS k, round(sum(o_totalprice), 2) AS total, count(*) AS orders
               FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT s_name AS user, n_name AS home_store, total, orders
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN sales ON k = n_nationkey
""")
def rls_home_store(t: Tables) -> DataFrame:
    """What every user sees under the home store label."""
    return home_store_sales(_store_totals(_store_orders(t)), "store", _users(t))


@query("""
SELECT n_name AS store, round(sum(o_totalprice), 2) AS total, count(*) AS orders
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1
""")
def rls_all_stores(t: Tables) -> DataFrame:
    """Without a label the signed-in user sees the sales of all stores."""
    seen = visible_sales(_store_orders(t), "store", _users(t), "Supplier#000000001")
    return _store_totals(seen)


@query("""
SELECT n_name AS store, round(sum(o_totalprice), 2) AS total, count(*) AS orders
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_name = 'Supplier#000000001')
GROUP BY 1
""")
def rls_home_label(t: Tables) -> DataFrame:
    """Under the home store label a user sees the own store."""
    seen = visible_sales(_store_orders(t), "store", _users(t), "Supplier#000000001", "Home Store")
    return _store_totals(seen)


@query("""
WITH home AS (SELECT s_nationkey AS h FROM supplier WHERE s_name = 'Supplier#000000001')
SELECT n_name AS store, round(sum(o_totalprice), 2) AS total, count(*) AS orders
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE n_name = (SELECT min(n_name) FROM nation) AND EXISTS (SELECT 1 FROM home WHERE h <> n_nationkey)
GROUP BY 1
""")
def rls_other_store(t: Tables) -> DataFrame:
    """Under another store's name a user sees that store."""
    name = t.nation.agg(F.min("n_name").alias("name")).first()["name"]
    return _store_totals(visible_sales(_store_orders(t), "store", _users(t), "Supplier#000000001", name))


@query("""
SELECT DISTINCT p_brand AS table_name, p_name || ' ' || p_size AS column_name FROM part
EXCEPT
SELECT p_brand, p_name || ' ' || p_size FROM part JOIN lineitem ON p_partkey = l_partkey
WHERE l_quantity > 45 AND l_returnflag = 'N'
""")
def unused_columns(t: Tables) -> DataFrame:
    """Columns of a source that the model does not have, by table and column name."""
    columns = t.part.select(
        "p_partkey", F.col("p_brand").alias("table_name"),
        F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("column_name"),
    )
    lines = t.lineitem.filter("l_quantity > 45 AND l_returnflag = 'N'")
    model = values_in_use(columns, "p_partkey", lines, "l_partkey")
    source = columns.select("table_name", "column_name").distinct()
    return not_in_model(source, model, ["table_name", "column_name"])


_OTHER_SQL = """
SELECT c_custkey AS ref, c_nationkey AS place,
       CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END AS balance,
       CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY')
            THEN replace(c_name, 'Customer', 'Custmer') ELSE upper(c_name) END AS title
FROM customer
"""


@query(f"""
WITH r AS ({_OTHER_SQL}),
e AS (SELECT c.*, x.ref AS exact FROM customer c
      LEFT JOIN (SELECT place, balance, min(ref) AS ref FROM r GROUP BY ALL) x
      ON c_nationkey = place AND c_acctbal = balance),
f AS (SELECT c_name AS n, min(levenshtein(c_name, title) * 1000000 + ref) AS best
      FROM e, r WHERE exact IS NULL AND levenshtein(c_name, title) <= 1 GROUP BY 1)
SELECT c_custkey, coalesce(exact, best % 1000000, -1) AS ref,
       CASE WHEN exact IS NOT NULL THEN 'exact' WHEN best IS NOT NULL THEN 'fuzzy'
            ELSE 'none' END AS rule,
       CASE WHEN exact IS NOT NULL THEN 0 ELSE coalesce(best // 1000000, -1) END::INT AS distance
FROM e LEFT JOIN f ON c_name = n
""", name="cascade_match")
def cascade_match_customers(t: Tables) -> DataFrame:
    """Customers found again in a second list by place and balance, else by name."""
    built = F.col("c_mktsegment") == "BUILDING"
    title = F.when(
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY"),
        F.replace("c_name", F.lit("Customer"), F.lit("Custmer")),
    ).otherwise(F.upper("c_name"))
    other = t.customer.select(
        F.col("c_custkey").alias("ref"), F.col("c_nationkey").alias("place"),
        F.when(built, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("balance"),
        title.alias("title"),
    )
    found = cascade_match(
        t.customer, other, [("c_nationkey", "place"), ("c_acctbal", "balance")],
        ("c_name", "title"), "ref",
    )
    return found.select(
        "c_custkey",
        F.coalesce("ref", F.lit(-1)).alias("ref"),
        F.coalesce("rule", F.lit("none")).alias("rule"),
        F.coalesce("distance", F.lit(-1)).alias("distance"),
    )


@query("""
WITH l AS (SELECT c_custkey AS ref, 'Custmer#' || substr(c_name, 10) AS title FROM customer WHERE c_mktsegment <> 'BUILDING'),
p AS (SELECT c_custkey, ref, levenshtein(c_name, title) AS distance FROM customer, l
      WHERE length(c_name) - length(title) BETWEEN -2 AND 2 AND levenshtein(c_name, title) <= 2)
SELECT c_custkey, coalesce(arg_min(ref, distance * 10000000000 + ref), -1) AS ref,
       CASE WHEN count(ref) > 0 THEN 'fuzzy' ELSE 'none' END AS rule, coalesce(min(distance), -1) AS distance
FROM customer LEFT JOIN p USING (c_custkey) GROUP BY c_custkey
""")
def cascade_match_shared_prefix(t: Tables) -> DataFrame:
    """Customers found within two edits in a list whose names all begin alike."""
    other = t.customer.filter("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").alias("ref"), (F.col("c_acctbal") + 0.5).alias("balance"),
        F.concat(F.lit("Custmer#"), F.substring("c_name", 10, 100)).alias("title"),
    )
    found = cascade_match(
        t.customer.select("c_custkey", "c_name", F.lit(-1e9).alias("c_acctbal")), other,
        [("c_acctbal", "balance")], ("c_name", "title"), "ref", limit=2,
    )
    return found.select(
        "c_custkey", F.coalesce("ref", F.lit(-1)).alias("ref"),
        F.coalesce("rule", F.lit("none")).alias("rule"), F.coalesce("distance", F.lit(-1)).alias("distance"),
    )


@query("""
WITH s AS (SELECT o_orderpriority AS priority, o_totalprice, c_mktsegment AS segment
           FROM orders JOIN customer ON o_custkey = c_custkey
           WHERE o_orderstatus = 'P')
SELECT priority, round(sum(CASE WHEN segment = 'BUILDING' THEN o_totalprice END), 2) AS filtered,
       round(sum(o_totalprice), 2) AS cleared,
       round(sum(CASE WHEN segment = 'BUILDING' THEN o_totalprice END) / sum(o_totalprice), 6) AS share
FROM s GROUP BY priority
""")
def filter_context(t: Tables) -> DataFrame:
    """A measure under all filters next to the same measure with one table cleared."""
    # one row per customer, status and priority meets the filters of the customer table
    sums = t.orders.groupBy("o_custkey", "o_orderstatus", "o_orderpriority").agg(
        F.sum("o_totalprice").alias("o_totalprice")
    )
    star = Star(sums, {"customer": Dimension(t.customer, "c_custkey", "o_custkey")})
    filters = {
        "fact": F.col("o_orderstatus") == "P",
        "customer": F.col("c_mktsegment") == "BUILDING",
    }
    priority = F.col("o_orderpriority").alias("priority")
    kept = star.filtered(filters).groupBy(priority).agg(F.sum("o_totalprice").alias("kept"))
    every = star.filtered(filters, clear=["customer"]).groupBy(priority).agg(
        F.sum("o_totalprice").alias("every")
    )
    return join_and_expand(every, kept, ["priority"], ["kept"]).select(
        "priority", cents(F.col("kept")).alias("filtered"), cents(F.col("every")).alias("cleared"),
        F.round(F.try_divide("kept", "every"), 6).alias("share"),
    )


def _priority_star(t: Tables) -> Star:
    """Order sums per customer, status and priority with their customers."""
    sums = t.orders.groupBy("o_custkey", "o_orderstatus", "o_orderpriority").agg(
        F.sum("o_totalprice").alias("o_totalprice")
    )
    return Star(sums, {"customer": Dimension(t.customer, "c_custkey", "o_custkey")})


def _context() -> FilterContext:
    return FilterContext((
        Filter("fact", "o_orderstatus", F.col("o_orderstatus") == "P"),
        Filter("customer", "c_mktsegment", F.col("c_mktsegment").isin("BUILDING", "MACHINERY")),
        Filter("customer", "c_acctbal", F.col("c_acctbal") > 0),
    ))


def _by_priority(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(F.col("o_orderpriority").alias("priority")).agg(cents(F.sum("o_totalprice")).alias(name))


@query("""
SELECT o_orderpriority AS priority,
       round(sum(CASE WHEN o_orderstatus = 'P' AND c_acctbal > 0 AND c_mktsegment = 'BUILDING' THEN o_totalprice END), 2) AS kept,
       round(sum(CASE WHEN o_orderstatus = 'P' AND c_acctbal > 0 AND c_mktsegment = 'FURNITURE' THEN o_totalprice END), 2) AS replaced
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
""")
def filters_kept_or_replaced(t: Tables) -> DataFrame:
    """A filter that joins those on its column, and one that takes their place."""
    star = _priority_star(t)
    kept = _context().keep(Filter("customer", "c_mktsegment", F.col("c_mktsegment") == "BUILDING"))
    replaced = _context().replace(Filter("customer", "c_mktsegment", F.col("c_mktsegment") == "FURNITURE"))
    every = _by_priority(star.fact, "every").drop("every")
    for name, context in (("kept", kept), ("replaced", replaced)):
        every = join_and_expand(every, _by_priority(star.under(context), name), ["priority"], [name])
    return every


@query("""
SELECT o_orderpriority AS priority,
       round(sum(CASE WHEN o_orderstatus = 'P' AND c_acctbal > 0 THEN o_totalprice END), 2) AS one_cleared,
       round(sum(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN o_totalprice END), 2) AS all_but_one,
       round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS table_cleared
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
""")
def filters_cleared(t: Tables) -> DataFrame:
    """One column's filter dropped, all filters but one dropped, a table's filters dropped."""
    star = _priority_star(t)
    every = _by_priority(star.fact, "every").drop("every")
    contexts = {
        "one_cleared": _context().clear("customer", "c_mktsegment"),
        "all_but_one": _context().clear_except(("customer", "c_mktsegment")),
        "table_cleared": _context().clear("customer"),
    }
    for name, context in contexts.items():
        every = join_and_expand(every, _by_priority(star.under(context), name), ["priority"], [name])
    return every


@query("""
WITH s AS (SELECT o_orderpriority AS priority, c_mktsegment AS segment, o_totalprice AS price, o_orderstatus = 'P' AS is_open,
                  c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') AS chosen, c_acctbal > 0 AS positive
           FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT priority, segment, sum(price) AS own FROM s WHERE is_open AND chosen AND positive GROUP BY ALL),
sel AS (SELECT priority, sum(price) AS selected FROM s WHERE is_open AND chosen AND positive GROUP BY ALL),
every AS (SELECT priority, sum(price) AS every_segment FROM s WHERE is_open AND positive GROUP BY ALL)
SELECT priority, segment, round(own, 2) AS own, round(selected, 2) AS selected, round(every_segment, 2) AS every_segment,
       round((SELECT sum(price) FROM s WHERE is_open AND chosen AND positive), 2) AS whole_selection, round(own / selected, 6) AS share
FROM g JOIN sel USING (priority) JOIN every USING (priority)
""")
def share_of_selection(t: Tables) -> DataFrame:
    """Segments of a selection against all selected ones, all segments and the whole selection."""
    star = Star(t.orders, {"customer": Dimension(t.customer, "c_custkey", "o_custkey")})
    selection = _context().replace(
        Filter("customer", "c_mktsegment", F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "FURNITURE"))
    )
    price = F.col("o_totalprice")
    sums = star.sums(
        selection, {"priority": ("fact", "o_orderpriority"), "segment": ("customer", "c_mktsegment")},
        {
            "own": (lambda c: c, price),
            "selected": (lambda c: c.all_selected("customer", "c_mktsegment"), price),
            "every_segment": (lambda c: c.clear("customer", "c_mktsegment"), price),
            "whole_selection": (lambda c: c.all_selected(), price),
        },
    )
    measures = ("own", "selected", "every_segment", "whole_selection")
    return sums.select(
        "priority", "segment", *[cents(F.col(c)).alias(c) for c in measures],
        F.round(F.try_divide("own", "selected"), 6).alias("share"),
    )


@query("""
SELECT o_orderpriority AS priority,
       round(sum(CASE WHEN o_orderstatus = 'P' AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0 THEN o_totalprice END), 2) AS own,
       round(sum(CASE WHEN o_orderstatus = 'P' AND c_mktsegment = 'FURNITURE' AND c_acctbal > 0 THEN o_totalprice END), 2) AS replaced,
       round(sum(CASE WHEN o_orderstatus = 'P' AND c_mktsegment = 'BUILDING' AND c_acctbal > 0 THEN o_totalprice END), 2) AS kept,
       round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS table_cleared,
       round(sum(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN o_totalprice END), 2) AS all_but_one
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
HAVING count(*) FILTER (o_orderstatus = 'P' AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0) > 0
""")
def contexts_in_one_scan(t: Tables) -> DataFrame:
    """Five contexts by priority, from one pass over the orders."""
    star = Star(t.orders, {"customer": Dimension(t.customer, "c_custkey", "o_custkey")})
    segment, price = F.col("c_mktsegment"), F.col("o_totalprice")
    sums = star.sums(
        _context(), {"priority": ("fact", "o_orderpriority")},
        {
            "own": (lambda c: c, price),
            "replaced": (lambda c: c.replace(Filter("customer", "c_mktsegment", segment == "FURNITURE")), price),
            "kept": (lambda c: c.keep(Filter("customer", "c_mktsegment", segment == "BUILDING")), price),
            "table_cleared": (lambda c: c.clear("customer"), price),
            "all_but_one": (lambda c: c.clear_except(("customer", "c_mktsegment"), ("fact", "o_orderpriority")), price),
        },
    )
    names = ("own", "replaced", "kept", "table_cleared", "all_but_one")
    return sums.select("priority", *[cents(F.col(c)).alias(c) for c in names])
