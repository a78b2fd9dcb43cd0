"""Queries over sources, column operators and scalar functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.dates import age_bucket, end_of_month, local_moment
from lodestar.functions.measures import selected_value
from lodestar.functions.text import is_like_null, split_camel_case, xml_json_field
from lodestar.operators.clean import (
    replace_with_default,
    set_types_from_model,
    split_camel_case_columns,
    union_restore_types,
)
from lodestar.operators.logs import CONTEXT_PATH
from lodestar.operators.measures import by_date_grain, include_or_exclude
from lodestar.queries.registry import Tables, cents, iso, query
from lodestar.sources.calendars import calendar_window_bridge, date_dimension, days_spanned
from lodestar.sources.staging import staging_path
from lodestar.sources.tables import expand_json_list, overwrite, read_typed_csv


@query("""
SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
       o_orderstatus,
       CASE WHEN o_orderstatus = 'P' THEN -1 ELSE left(o_orderpriority, 1)::INT END AS priority
FROM orders
""")
def csv_typed_scan(t: Tables) -> DataFrame:
    """Orders written as CSV and read back with types; a value that fails is null."""
    path = staging_path(t.spark)
    number = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(
        F.substring("o_orderpriority", 1, 1)
    )
    t.orders.select(
        "o_orderkey", "o_totalprice", iso("o_orderdate").alias("o_orderdate"),
        "o_orderstatus", number.alias("priority"),
    ).write.option("header", True).option("quote", "").csv(path)
    types = T.StructType(
        [
            T.StructField("o_orderkey", T.LongType()),
            T.StructField("o_totalprice", T.DoubleType()),
            T.StructField("o_orderdate", T.DateType()),
            T.StructField("o_orderstatus", T.StringType()),
            T.StructField("priority", T.IntegerType()),
        ]
    )
    return read_typed_csv(t.spark, path, types).select(
        "o_orderkey", "o_totalprice", iso("o_orderdate").alias("o_orderdate"),
        "o_orderstatus", F.coalesce("priority", F.lit(-1)).alias("priority"),
    )


@query("""
SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer
""")
def csv_other_column_order(t: Tables) -> DataFrame:
    """Customers from a CSV whose header lists the columns in another order."""
    path = staging_path(t.spark)
    t.customer.select("c_mktsegment", "c_acctbal", "c_name", "c_custkey").write.option(
        "header", True
    ).option("quote", "").csv(path)
    types = T.StructType.fromDDL("c_custkey long, c_name string, c_acctbal double, c_mktsegment string")
    return read_typed_csv(t.spark, path, types).withColumn("c_acctbal", cents(F.col("c_acctbal")))


@query("""
WITH objects AS (
  SELECT event_id AS Number, event_type AS Title, 'open' AS State, ts FROM events
  UNION ALL
  SELECT event_id, '[' || event_type || '] ' || json_extract_string(props, '$.k'), 'closed', ts
  FROM events
)
SELECT Number, Title, State, strftime(ts, '%Y-%m-%d %H:%M:%S') AS CreatedAt,
       CASE (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(date_trunc('second', ts))) // 86400000000
         WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday'
         ELSE ((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(date_trunc('second', ts)))
               // 86400000000)::VARCHAR || ' days ago' END AS Age
FROM objects
""")
def json_list_expand(t: Tables) -> DataFrame:
    """JSON lists of issues expanded to typed rows with their age."""
    created = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at")
    number = F.col("event_id").alias("number")
    bracketed = F.concat(
        F.lit("["), F.col("event_type"), F.lit("] "), F.get_json_object("props", "$.k")
    )
    lists = t.events.select(
        F.to_json(
            F.array(
                F.struct(number, F.col("event_type").alias("title"), F.lit("open").alias("state"), created),
                F.struct(number, bracketed.alias("title"), F.lit("closed").alias("state"), created),
            )
        ).alias("document")
    )
    record = T.StructType.fromDDL("number long, title string, state string, created_at string")
    issues = expand_json_list(lists, "document", record, ["Number", "Title", "State", "CreatedAt"])
    moment = F.col("CreatedAt").cast("timestamp_ntz")
    now = local_moment(dt.datetime(2024, 1, 31))
    return issues.select(
        "Number", "Title", "State",
        F.date_format(moment, "yyyy-MM-dd HH:mm:ss").alias("CreatedAt"),
        age_bucket(moment, now).alias("Age"),
    )


@query("""
SELECT strftime(d, '%Y-%m-%d') AS "Date", year(d)::INT AS "Year", strftime(d, '%b') AS "Month",
       month(d)::INT AS "Month Number", 'Q' || quarter(d) AS "Quarter"
FROM (SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE,
                                    INTERVAL 1 DAY))::DATE AS d FROM orders)
""", name="date_dimension")
def date_dimension_of_orders(t: Tables) -> DataFrame:
    """A date table that spans all order dates."""
    days = days_spanned(t.daily_orders, "day")
    return date_dimension(days).withColumn("Date", iso("Date"))


@query("""
WITH c AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders),
b AS (SELECT d, size, shift, unnest(generate_series(0, size - 1)) AS ahead
      FROM c, (VALUES (28), (7)) AS s(size), (VALUES (0), (-7), (-28), (-365)) AS h(shift))
SELECT strftime(d + shift, '%Y-%m-%d') AS dim_calendar_key,
       strftime(d + ahead::INT, '%Y-%m-%d') AS window_day,
       size AS window_day_size, shift AS window_day_shift
FROM b
""", name="calendar_window_bridge")
def calendar_window_bridge_of_orders(t: Tables) -> DataFrame:
    """The window bridge over all order dates, written as a table and read back."""
    calendar = t.daily_orders.select("day").distinct()
    bridge = overwrite(calendar_window_bridge(calendar, "day"), staging_path(t.spark))
    return bridge.select(
        iso("DIM_CalendarKey").alias("dim_calendar_key"),
        iso("Window").alias("window_day"),
        F.col("WindowDaySize").alias("window_day_size"),
        F.col("WindowDayShift").alias("window_day_shift"),
    )


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000")
def filter_rows(t: Tables) -> DataFrame:
    return t.orders.filter("o_totalprice > 250000").select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'small')")
def filter_prefix(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_name").startswith("small")).select("p_partkey", "p_name")


@query("""
SELECT l_orderkey AS "L _orderkey", l_partkey AS "Part", l_linenumber AS "L _linenumber",
       l_quantity AS "Line Quantity", l_returnflag AS "L _returnflag" FROM lineitem
""")
def rename_camel_columns(t: Tables) -> DataFrame:
    """Readable column names, with one given name."""
    lines = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber",
        F.col("l_quantity").alias("lineQuantity"), "l_returnflag",
    )
    return split_camel_case_columns(lines, {"l_partkey": "Part"})


@query("""
SELECT event_id, CASE days WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday'
                 ELSE days::VARCHAR || ' days ago' END AS age
FROM (SELECT event_id,
             (epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(ts)) // 86400000000 AS days
      FROM events)
""", name="age_bucket")
def age_bucket_of_events(t: Tables) -> DataFrame:
    now = local_moment(dt.datetime(2024, 1, 31, 12))
    return t.events.select("event_id", age_bucket("ts", now).alias("age"))


@query("""
SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
       o_orderstatus AS note FROM orders
""", name="set_types_from_model")
def set_types_from_model_table(t: Tables) -> DataFrame:
    """Orders held as text get the types of the orders table; the note stays text."""
    model = t.orders.select("o_orderkey", "o_totalprice", "o_orderdate")
    text = t.orders.select(
        *[F.col(c).cast("string").alias(c) for c in model.columns],
        F.col("o_orderstatus").alias("note"),
    )
    typed = set_types_from_model(text, model)
    return typed.withColumn("o_orderdate", iso("o_orderdate"))


_MISSING_SQL = """CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN 'BLank'
     WHEN '3-MEDIUM' THEN '' ELSE o_orderpriority END"""


def _gaps(t: Tables) -> DataFrame:
    """Orders with missing texts, keys and numbers."""
    return t.orders.select(
        "o_orderkey",
        F.expr(_MISSING_SQL).alias("priority"),
        F.expr(_MISSING_SQL).alias("raw_priority"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("_SKey Customer"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("price"),
    )


@query(f"""
SELECT o_orderkey,
       CASE WHEN p IS NULL OR lower(p) IN ('blank', 'empty', 'unknown', 'null', '')
            THEN 'Unknown' ELSE p END AS priority,
       p IS NULL AS raw_is_null,
       CASE WHEN o_orderstatus = 'P' THEN -1 ELSE o_custkey END AS skey,
       CASE WHEN o_orderstatus = 'F' THEN 'none' ELSE 'some' END AS price
FROM (SELECT *, {_MISSING_SQL} AS p FROM orders)
""", name="replace_with_default")
def replace_with_default_texts(t: Tables) -> DataFrame:
    """Texts and keys get defaults; numbers and unlisted columns keep their nulls."""
    clean = replace_with_default(_gaps(t), ["priority", "_SKey Customer", "price"])
    return clean.select(
        "o_orderkey", "priority",
        F.col("raw_priority").isNull().alias("raw_is_null"),
        F.col("_SKey Customer").alias("skey"),
        F.when(F.col("price").isNull(), "none").otherwise("some").alias("price"),
    )


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE o_custkey END AS skey,
       CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END AS price
FROM orders
""")
def replace_with_default_numbers(t: Tables) -> DataFrame:
    clean = replace_with_default(_gaps(t), ["_SKey Customer", "price"], replace_numbers=True)
    return clean.select("o_orderkey", F.col("_SKey Customer").alias("skey"), "price")


@query(f"""
SELECT o_orderkey, p IS NULL OR lower(p) IN ('blank', 'empty', 'unknown', 'null', '') AS text_flag,
       o_orderstatus = 'P' AS number_flag
FROM (SELECT *, {_MISSING_SQL} AS p FROM orders)
""", name="is_like_null")
def is_like_null_flags(t: Tables) -> DataFrame:
    return _gaps(t).select(
        "o_orderkey",
        is_like_null("priority").alias("text_flag"),
        is_like_null("`_SKey Customer`").alias("number_flag"),
    )


@query("""
SELECT CASE WHEN n_regionkey = 0 THEN 'none' ELSE n_name END AS location,
       round(sum(l_extendedprice), 2) AS amount
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
WHERE n_name <> 'NATION_7'
GROUP BY ALL
""")
def optional_exclusion(t: Tables) -> DataFrame:
    """Totals without one location; rows without any location stay."""
    named = F.when(F.col("n_regionkey") != 0, F.col("n_name"))
    places = t.nation.select("n_nationkey", named.alias("location"))
    suppliers = t.supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    sums = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("amount"))
    lines = sums.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    kept = lines.filter(include_or_exclude("No", "location", "NATION_7"))
    return kept.groupBy(F.coalesce("location", F.lit("none")).alias("location")).agg(
        cents(F.sum("amount")).alias("amount")
    )


@query("""
SELECT o_custkey, coalesce(CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN max(o_orderstatus) END,
                           'several') AS status
FROM orders GROUP BY o_custkey
""", name="selected_value")
def selected_value_per_customer(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(
        selected_value("o_orderstatus", F.lit("several")).alias("status")
    )


@query("""
SELECT grain, strftime(date_trunc(grain, o_orderdate), '%Y-%m-%d') AS period,
       round(sum(o_totalprice), 2) AS total
FROM orders, (VALUES ('Year'), ('Quarter'), ('Month'), ('Day')) AS g(grain)
GROUP BY ALL
""")
def field_parameter_group(t: Tables) -> DataFrame:
    """The same measure by every date grain a reader can choose."""
    measures = {"total": cents(F.sum("o_totalprice"))}
    out = None
    for grain in ("Year", "Quarter", "Month", "Day"):
        part = by_date_grain(t.daily_orders, "day", grain, measures).select(
            F.lit(grain).alias("grain"), iso("period").alias("period"), "total"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("""
SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer
UNION ALL SELECT s_suppkey, s_name, round(s_acctbal, 2) FROM supplier
""", name="union_restore_types")
def union_restore_types_of_parties(t: Tables) -> DataFrame:
    """Customers with suppliers below them, the latter held as text."""
    customers = t.customer.select("c_custkey", "c_name", "c_acctbal")
    suppliers = t.supplier.select(
        F.col("s_suppkey").cast("string").alias("c_custkey"),
        F.col("s_name").alias("c_name"),
        F.col("s_acctbal").cast("string").alias("c_acctbal"),
    )
    return union_restore_types(customers, suppliers)


_CAMEL_TEXT = "p_name || ' ' || p_type || p_brand || '  ' || p_size || 'x' || p_name"


@query(f"""
WITH s AS (SELECT p_partkey, {_CAMEL_TEXT} AS t FROM part),
c AS (SELECT p_partkey, t, i, t[i] AS c, t[i + 1] AS after, rtrim(t[1:i - 1]) AS before
      FROM s, generate_series(1, 80) AS g(i) WHERE i <= length(t)),
m AS (SELECT *, before <> '' AND right(before, 1) <> upper(right(before, 1)) AS after_lower,
             c = upper(c) AS up, after <> upper(after) AS before_lower,
             length(before) < i - 1 AS spaced
      FROM c WHERE c <> ' '),
w AS (SELECT p_partkey, string_agg(
        CASE WHEN before <> '' AND ((up AND before_lower) OR (after_lower AND (up OR spaced)))
             THEN ' ' ELSE '' END || c, '' ORDER BY i) AS w
      FROM m GROUP BY p_partkey)
SELECT p_partkey, upper(w[1]) || w[2:] AS words FROM w
""", name="split_camel_case")
def split_camel_case_texts(t: Tables) -> DataFrame:
    text = F.concat(
        "p_name", F.lit(" "), "p_type", "p_brand", F.lit("  "),
        F.col("p_size").cast("string"), F.lit("x"), "p_name",
    )
    return t.part.select("p_partkey", split_camel_case(text).alias("words"))


@query("""
SELECT doc_id, md5(lower(text)) AS lower_text, md5(left(text, 40)) AS start_text,
       md5(right(text, 40)) AS end_text, length(text) AS n, md5(trim(text)) AS trimmed,
       md5(upper(lang) || reverse(source)) AS names,
       length(text) - length(replace(text, ' ', '')) + 1 AS pieces
FROM documents
""")
def text_functions(t: Tables) -> DataFrame:
    """The text functions over whole documents."""
    return t.documents.select(
        "doc_id",
        F.md5(F.lower("text")).alias("lower_text"),
        F.md5(F.left("text", F.lit(40))).alias("start_text"),
        F.md5(F.right("text", F.lit(40))).alias("end_text"),
        F.length("text").cast("long").alias("n"),
        F.md5(F.trim("text")).alias("trimmed"),
        F.md5(F.concat(F.upper("lang"), F.reverse("source"))).alias("names"),
        F.size(F.split("text", " ")).cast("long").alias("pieces"),
    )


@query("""
SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day,
       strftime(last_day(o_orderdate), '%Y-%m-%d') AS this_month,
       strftime(last_day(o_orderdate - INTERVAL 1 MONTH), '%Y-%m-%d') AS last_month
FROM orders
""")
def eomonth(t: Tables) -> DataFrame:
    return t.daily_orders.select("day").distinct().select(
        iso("day").alias("day"),
        iso(end_of_month("day")).alias("this_month"),
        iso(end_of_month("day", -1)).alias("last_month"),
    )


def request_properties() -> Column:
    """Event properties as the request property list of a query log."""
    return F.concat(
        F.lit("<PropertyList><Catalog>m</Catalog><ApplicationContext>"),
        F.lit('{"Sources":[{"ReportId":"r'), F.get_json_object("props", "$.k"),
        F.lit('","VisualId":"'), F.col("event_type"),
        F.lit('"}]}</ApplicationContext></PropertyList>'),
    )


@query("""
SELECT event_id, 'r' || json_extract_string(props, '$.k') AS report_id, event_type AS visual_id
FROM events
""")
def xml_context_extract(t: Tables) -> DataFrame:
    """JSON fields inside an XML element."""
    logs = t.events.select("event_id", request_properties().alias("xml"))
    return logs.select(
        "event_id",
        xml_json_field("xml", CONTEXT_PATH, "$.Sources[0].ReportId").alias("report_id"),
        xml_json_field("xml", CONTEXT_PATH, "$.Sources[0].VisualId").alias("visual_id"),
    )
