"""Queries over rolling counts, running totals and time intelligence."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.dates import fiscal_year
from lodestar.operators.joins import Dimension, Star, join_and_expand, without_members
from lodestar.operators.ordered import add_index, cumulative_to_incremental
from lodestar.plans.bitmaps import (
    count_windows,
    day_bitmaps,
    key_bitmap,
    read_bitmaps,
    window_days,
    write_bitmaps,
)
from lodestar.plans.rolling import (
    append_marks,
    count_marked,
    count_marked_by_window,
    count_marked_on,
    days_with_facts,
    mark_days,
    month_end_days,
    read_marks,
    rolling_distinct,
    rolling_distinct_trend,
)
from lodestar.plans.running import running_total, running_total_adjusted, years_spanned
from lodestar.plans.sketches import BITS, approx_windows, day_sketches
from lodestar.plans.time_intelligence import Measure, time_intelligence
from lodestar.queries.registry import Tables, cents, iso, query
from lodestar.sources.calendars import calendar_window_bridge, date_bounds, days_between, days_spanned
from lodestar.sources.staging import stage, staging_path

FIRST, LAST = dt.date(1995, 6, 1), dt.date(2001, 6, 30)

_SELECTED = f"day BETWEEN DATE '{FIRST}' AND DATE '{LAST}'"


def _building(t: Tables, shift: int = 0, size: int = 28) -> DataFrame:
    """Customers of one segment with their order days for windows of some days.

    The filter follows the marking: a busy customer is one row per eight weeks.
    """
    marks = mark_days(t.daily_orders, ["o_custkey"], "day", (FIRST, LAST), size, shift)
    star = Star(marks, {"customer": Dimension(t.customer, "c_custkey", "o_custkey")})
    return star.filtered({"customer": F.col("c_mktsegment") == "BUILDING"})


_PAIRS_SQL = """p AS (SELECT DISTINCT o_custkey AS thing, o_orderdate::DATE AS day
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')"""

_DAYS_SQL = f"""cal AS (SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE,
                                       INTERVAL 1 DAY))::DATE AS day FROM orders),
sel AS (SELECT day FROM cal WHERE day BETWEEN DATE '{FIRST}' AND DATE '{LAST}'),
l AS (SELECT max(o_orderdate)::DATE AS last FROM orders
      WHERE o_orderdate::DATE BETWEEN DATE '{FIRST}' AND DATE '{LAST}'),
d AS (SELECT day FROM sel, l WHERE day <= last
      AND (day > last_day(last - INTERVAL 1 MONTH) OR day = last_day(day)))"""


@query(f"""
WITH {_PAIRS_SQL},
d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders
      WHERE o_orderdate::DATE BETWEEN DATE '{FIRST}' AND DATE '{LAST}')
SELECT strftime(d.day, '%Y-%m-%d') AS day, count(DISTINCT thing) AS n
FROM d JOIN p ON p.day BETWEEN d.day - 27 AND d.day GROUP BY d.day
""")
def rolling_distinct_28d(t: Tables) -> DataFrame:
    """Customers of a segment with an order in the last 28 days, for days with orders."""
    days = days_with_facts(t.daily_orders, "day").filter(_SELECTED)
    counts = count_marked(_building(t), "o_custkey", 28, days)
    return counts.withColumn("day", iso("day"))


@query("""
WITH p AS (SELECT DISTINCT CASE WHEN event_type = 'error' THEN -1 ELSE user_id END AS thing,
                  ts::DATE AS day FROM events)
SELECT strftime(d.day, '%Y-%m-%d') AS day, count(DISTINCT thing) AS n
FROM (SELECT DISTINCT day FROM p) d JOIN p ON p.day BETWEEN d.day - 6 AND d.day GROUP BY d.day
""")
def rolling_distinct_7d(t: Tables) -> DataFrame:
    """Users of the last 7 days; all events without a user count as one more."""
    events = t.events.select(
        F.when(F.col("event_type") != "error", F.col("user_id")).alias("user"),
        F.to_date("ts").alias("day"),
    )
    days = days_with_facts(events, "day")
    return rolling_distinct(events, "user", "day", 7, days).withColumn("day", iso("day"))


def _calendar(t: Tables) -> DataFrame:
    """All days from the first to the last order."""
    return days_between(t.spark, *date_bounds(t.daily_orders, "day"))


@query(f"""
WITH {_PAIRS_SQL}, {_DAYS_SQL}
SELECT strftime(d.day, '%Y-%m-%d') AS day, count(DISTINCT thing) AS n
FROM d JOIN p ON p.day BETWEEN d.day - 27 AND d.day GROUP BY d.day
""")
def rolling_distinct_month_end(t: Tables) -> DataFrame:
    """Days of the last selected month and earlier month ends, also without orders."""
    days = month_end_days(t.daily_orders, "day", _calendar(t).filter(_SELECTED))
    counts = count_marked_on(_building(t), "o_custkey", 28, days)
    return counts.withColumn("day", iso("day"))


@query(f"""
WITH {_PAIRS_SQL}, {_DAYS_SQL}
SELECT strftime(d.day, '%Y-%m-%d') AS window_day, count(DISTINCT thing) AS n
FROM d JOIN p ON p.day BETWEEN d.day - 27 AND d.day GROUP BY d.day
""", name="rolling_distinct_bridge")
def rolling_distinct_by_window(t: Tables) -> DataFrame:
    """The same measure by window date through the bridge."""
    return _by_window(t)


def _by_window(t: Tables, shift: int = 0, size: int = 28) -> DataFrame:
    calendar = _calendar(t)
    counts = count_marked_by_window(
        _building(t, shift, size), t.daily_orders, "o_custkey", "day",
        calendar_window_bridge(calendar, "day"), calendar.filter(_SELECTED), size, shift,
    )
    return counts.withColumn("window_day", iso("window_day"))


@query(f"""
WITH {_PAIRS_SQL}, {_DAYS_SQL}
SELECT strftime(d.day, '%Y-%m-%d') AS window_day, count(DISTINCT thing) AS n
FROM d JOIN p ON p.day BETWEEN d.day - 27 - 365 AND d.day - 365 GROUP BY d.day
""")
def rolling_distinct_bridge_py(t: Tables) -> DataFrame:
    """The windows of a year earlier."""
    return _by_window(t, shift=-365)


@query(f"""
WITH {_PAIRS_SQL}, {_DAYS_SQL}
SELECT strftime(d.day, '%Y-%m-%d') AS window_day, count(DISTINCT thing) AS n
FROM d JOIN p ON p.day BETWEEN d.day - 6 - 7 AND d.day - 7 GROUP BY d.day
""")
def rolling_distinct_bridge_7d_week(t: Tables) -> DataFrame:
    """Windows of seven days, a week earlier."""
    return _by_window(t, shift=-7, size=7)


@query(f"""
WITH {_PAIRS_SQL}, {_DAYS_SQL}
SELECT strftime(d.day, '%Y-%m-%d') AS window_day, count(DISTINCT thing) AS n
FROM d JOIN p ON p.day BETWEEN d.day - 27 - 28 AND d.day - 28 GROUP BY d.day
""")
def rolling_distinct_bridge_28d_back(t: Tables) -> DataFrame:
    """Windows of 28 days, 28 days earlier."""
    return _by_window(t, shift=-28)


@query(f"""
WITH {_PAIRS_SQL}, {_DAYS_SQL}
SELECT strftime(d.day, '%Y-%m-%d') AS window_day, count(DISTINCT thing) AS n
FROM d JOIN p ON p.day BETWEEN d.day - 27 AND d.day GROUP BY d.day
""")
def rolling_distinct_stored_marks(t: Tables) -> DataFrame:
    """The bridge over marks that were stored in two periods."""
    path = staging_path(t.spark)
    marks = mark_days(t.daily_orders, ["o_custkey"], "day")
    for half in (0, 1):
        append_marks(marks.filter(F.col("_block") % 2 == half), path)
    stored = read_marks(marks, path, (FIRST - dt.timedelta(days=27), LAST))
    star = Star(stored, {"customer": Dimension(t.customer, "c_custkey", "o_custkey")})
    calendar = _calendar(t)
    counts = count_marked_by_window(
        star.filtered({"customer": F.col("c_mktsegment") == "BUILDING"}), t.daily_orders, "o_custkey", "day",
        calendar_window_bridge(calendar, "day"), calendar.filter(_SELECTED),
    )
    return counts.withColumn("window_day", iso("window_day"))


def _stored_bitmaps(t: Tables, size: int = 28) -> DataFrame:
    """Customers by day as bitmaps, written in two runs of which the second is repeated."""
    path = staging_path(t.spark)
    read = (FIRST - dt.timedelta(days=size - 1), LAST)
    bitmaps = day_bitmaps(t.daily_orders.filter(F.col("day").between(*map(F.lit, read))), "o_custkey", "day")
    month = F.trunc(F.lit(FIRST), "month")
    write_bitmaps(bitmaps.filter(F.col("day") < month), path)
    for _ in range(2):
        write_bitmaps(bitmaps.filter(F.col("day") >= month), path)
    return read_bitmaps(bitmaps, path, read)


@query(f"""
WITH {_PAIRS_SQL}, {_DAYS_SQL}
SELECT strftime(d.day, '%Y-%m-%d') AS day, count(DISTINCT thing) AS n
FROM d JOIN p ON p.day BETWEEN d.day - 27 AND d.day GROUP BY d.day
""")
def rolling_bitmaps_month_end(t: Tables) -> DataFrame:
    """Month ends from stored bitmaps, cut by the bitmap of a segment's customers."""
    stored = _stored_bitmaps(t)
    days = month_end_days(stored.select("day"), "day", _calendar(t).filter(_SELECTED))
    building = key_bitmap(t.customer.filter("c_mktsegment = 'BUILDING'"), "c_custkey")
    return count_windows(stored, window_days(days, 28), building).select(iso("window").alias("day"), "n")


@query("""
WITH p AS (SELECT DISTINCT user_id AS thing, ts::DATE AS day FROM events WHERE event_type IN ('view', 'click'))
SELECT strftime(d.day, '%Y-%m-%d') AS window_day, count(DISTINCT thing) AS n
FROM (SELECT DISTINCT ts::DATE AS day FROM events) d JOIN p ON p.day BETWEEN d.day - 6 - 7 AND d.day - 7 GROUP BY d.day
""")
def rolling_bitmaps_bridge_by_kind(t: Tables) -> DataFrame:
    """Users of two kinds of events by windows of the bridge, from bitmaps by kind of event."""
    events = t.events.select("user_id", "event_type", F.to_date("ts").alias("day"))
    bitmaps = day_bitmaps(events, "user_id", "day", ["event_type"]).filter(F.col("event_type").isin("view", "click"))
    days = days_with_facts(events, "day")
    bridge = calendar_window_bridge(days_spanned(events, "day"), "day").filter("WindowDaySize = 7 and WindowDayShift = -7")
    windows = bridge.select(F.col("Window").alias("window"), F.col("DIM_CalendarKey").alias("held"))
    wanted = windows.join(days.select(F.col("day").alias("window")), "window", "left_semi")
    return count_windows(bitmaps, wanted).select(iso("window").alias("window_day"), "n")


@query(f"""
WITH {_PAIRS_SQL}, {_DAYS_SQL}
SELECT strftime(d.day, '%Y-%m-%d') AS day, count(DISTINCT thing) AS exact, true AS near
FROM d JOIN p ON p.day BETWEEN d.day - 27 AND d.day GROUP BY d.day
""")
def rolling_sketches_month_end(t: Tables) -> DataFrame:
    """Month ends from stored sketches, within four standard errors of the exact counts."""
    orders = Star(
        t.daily_orders.filter(F.col("day").between(F.lit(FIRST - dt.timedelta(days=27)), F.lit(LAST))),
        {"customer": Dimension(t.customer, "c_custkey", "o_custkey")},
    ).filtered({"customer": F.col("c_mktsegment") == "BUILDING"})
    sketches = stage(day_sketches(orders, "o_custkey", "day"))
    days = month_end_days(t.daily_orders, "day", _calendar(t).filter(_SELECTED))
    close = approx_windows(sketches, window_days(days, 28), "approx")
    exact = count_marked_on(mark_days(orders, ["o_custkey"], "day"), "o_custkey", 28, days, "exact")
    error = 4 * 1.04 / 2 ** (BITS / 2)
    near = F.abs(F.col("approx") - F.col("exact")) <= F.greatest(F.col("exact") * error, F.lit(1))
    return exact.join(close, exact.day == close.window).select(iso("day").alias("day"), "exact", near.alias("near"))


def _trend(t: Tables, by: str) -> DataFrame:
    star = Star(t.daily_orders, {"customer": Dimension(t.customer, "c_custkey", "o_custkey")})
    calendar = _calendar(t)
    return rolling_distinct_trend(
        star.filtered({"customer": F.col("c_mktsegment") == "BUILDING"}), t.daily_orders, "o_custkey", "day",
        calendar.filter(_SELECTED), by, calendar_window_bridge(calendar, "day"), between=(FIRST, LAST),
    )


@query(f"""
WITH {_PAIRS_SQL}, {_DAYS_SQL}
SELECT strftime(d.day, '%Y-%m-%d') AS day, count(DISTINCT thing) AS n
FROM d JOIN p ON p.day BETWEEN d.day - 27 AND d.day GROUP BY d.day
""")
def rolling_trend_by_day(t: Tables) -> DataFrame:
    """The one measure for both groupings, by calendar day."""
    return _trend(t, "day").withColumn("day", iso("day"))


@query(f"""
WITH {_PAIRS_SQL}, {_DAYS_SQL}
SELECT strftime(d.day, '%Y-%m-%d') AS window_day, count(DISTINCT thing) AS n
FROM d JOIN p ON p.day BETWEEN d.day - 27 AND d.day GROUP BY d.day
""")
def rolling_trend_by_window(t: Tables) -> DataFrame:
    """The one measure for both groupings, by window."""
    return _trend(t, "window").withColumn("window_day", iso("window_day"))


@query("""
WITH y AS (SELECT unnest(generate_series(min(year(o_orderdate + INTERVAL 6 MONTH)),
                                         max(year(o_orderdate + INTERVAL 6 MONTH)))) AS fy FROM orders),
s AS (SELECT year(o_orderdate + INTERVAL 6 MONTH) AS fy, sum(o_totalprice) AS total
      FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT y.fy::INT AS fiscal_year, round(sum(total) OVER (ORDER BY y.fy), 2) AS running_total
FROM y LEFT JOIN s ON y.fy = s.fy
""")
def running_total_fy(t: Tables) -> DataFrame:
    """Running total of pending orders by fiscal year."""
    year = fiscal_year("o_orderdate")
    totals = t.orders.filter("o_orderstatus = 'P'").groupBy(year.alias("fiscal_year")).agg(
        F.sum("o_totalprice").alias("total")
    )
    out = running_total(totals, "fiscal_year", "total", years_spanned(t.orders, year))
    return out.withColumn("running_total", cents(F.col("running_total")))


@query("""
WITH y AS (SELECT unnest(generate_series(min(year(l_shipdate + INTERVAL 6 MONTH)),
                                         max(year(l_shipdate + INTERVAL 6 MONTH)))) AS fy FROM lineitem),
s AS (SELECT year(l_shipdate + INTERVAL 6 MONTH) AS fy,
             sum(l_extendedprice * (p_size / 100.0) / nullif(p_size - 1, 0)) AS total
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
      JOIN nation ON s_nationkey = n_nationkey
      WHERE n_name <> 'NATION_7' AND l_linestatus = 'F' GROUP BY 1)
SELECT y.fy::INT AS fiscal_year, round(sum(total) OVER (ORDER BY y.fy), 2) AS running_total
FROM y LEFT JOIN s ON y.fy = s.fy
""", name="running_total_adjusted")
def running_total_of_lines(t: Tables) -> DataFrame:
    """Adjusted running total of one snapshot without one location."""
    year = fiscal_year("l_shipdate")
    places = join_and_expand(t.supplier, t.nation, ["s_nationkey"], ["n_name"], target_on=["n_nationkey"])
    # only the keys of the excluded location meet the lines
    lines = without_members(
        t.lineitem.filter("l_linestatus = 'F'"), "l_suppkey", places, "s_suppkey",
        F.col("n_name") == "NATION_7",
    )
    out = running_total_adjusted(
        lines.select(year.alias("fiscal_year"), "l_partkey", "l_extendedprice"),
        "fiscal_year", F.col("l_extendedprice"), "l_partkey", t.part, "p_partkey",
        F.col("p_size") / 100.0, F.col("p_size") - 1, years_spanned(t.lineitem, year),
    )
    return out.withColumn("running_total", cents(F.col("running_total")))


@query("""
SELECT o_custkey, o_orderkey, o_totalprice AS running_total,
       round(o_totalprice - coalesce(lag(o_totalprice) OVER (
         PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 0), 2) AS running_total_incremental
FROM orders
""", name="cumulative_to_incremental")
def cumulative_to_incremental_orders(t: Tables) -> DataFrame:
    """Order prices taken as meter readings of their customer."""
    readings = t.orders.select(
        "o_orderkey", "o_custkey", "o_orderdate", F.col("o_totalprice").alias("running_total")
    )
    out = cumulative_to_incremental(
        readings, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["running_total"]
    )
    return out.select(
        "o_custkey", "o_orderkey", "running_total",
        cents(F.col("running_total Incremental")).alias("running_total_incremental"),
    )


@query("""
WITH e AS (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)
SELECT event_id, user_id, event_type, k,
       round(value - coalesce(lag(value) OVER w, 0), 2) AS value_change,
       k - coalesce(lag(k) OVER w, 0) AS k_change
FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)
""")
def cumulative_to_incremental_multi(t: Tables) -> DataFrame:
    """Two readings at once, grouped by two columns."""
    readings = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("int")).drop("props")
    out = cumulative_to_incremental(
        readings, ["user_id", "event_type"], ["ts", "event_id"], ["value", "k"]
    )
    return out.select(
        "event_id", "user_id", "event_type", "k",
        cents(F.col("value Incremental")).alias("value_change"),
        F.col("k Incremental").alias("k_change"),
    )


@query("""
SELECT event_id, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS index FROM events
""", name="add_index")
def add_index_to_events(t: Tables) -> DataFrame:
    """Events numbered by user and time."""
    return add_index(t.events, "index", ["user_id", "ts", "event_id"]).select("event_id", "index")


_TOTALS_SQL = """
c AS (SELECT unnest(generate_series(min(o_orderdate)::DATE, max(o_orderdate)::DATE,
                                    INTERVAL 1 DAY))::DATE AS day FROM orders),
s AS (SELECT o_orderdate::DATE AS day, sum(o_totalprice) AS total FROM orders GROUP BY 1),
r AS (SELECT c.day, s.total, p.total AS py FROM c LEFT JOIN s ON c.day = s.day
      LEFT JOIN s p ON p.day = (c.day - INTERVAL 1 YEAR)::DATE)"""


def _daily_variant(t: Tables, variant: str, column: str, digits: int = 2) -> DataFrame:
    measures = {"Total": Measure(F.sum("o_totalprice"))}
    rows = time_intelligence(t.daily_orders, "day", measures, [variant])
    value = F.col(f"`Total {variant}`")
    return rows.filter(value.isNotNull()).select(
        iso("day").alias("day"), F.round(value, digits).alias(column)
    )


def _to_date_sql(column: str, periods: str) -> str:
    return f"""
WITH {_TOTALS_SQL}
SELECT strftime(day, '%Y-%m-%d') AS day, round(v, 2) AS {column}
FROM (SELECT day, sum(total) OVER (PARTITION BY {periods} ORDER BY day) AS v FROM r)
WHERE v IS NOT NULL"""


@query(_to_date_sql("ytd", "year(day)"))
def ti_ytd(t: Tables) -> DataFrame:
    return _daily_variant(t, "YTD", "ytd")


@query(_to_date_sql("qtd", "year(day), quarter(day)"))
def ti_qtd(t: Tables) -> DataFrame:
    return _daily_variant(t, "QTD", "qtd")


@query(_to_date_sql("mtd", "year(day), month(day)"))
def ti_mtd(t: Tables) -> DataFrame:
    return _daily_variant(t, "MTD", "mtd")


@query(f"""
WITH {_TOTALS_SQL}
SELECT strftime(day, '%Y-%m-%d') AS day, round(py, 2) AS py FROM r WHERE py IS NOT NULL
""")
def ti_py(t: Tables) -> DataFrame:
    return _daily_variant(t, "PY", "py")


@query(f"""
WITH {_TOTALS_SQL}
SELECT strftime(day, '%Y-%m-%d') AS day, round(coalesce(total, 0) - coalesce(py, 0), 2) AS yoy
FROM r WHERE total IS NOT NULL OR py IS NOT NULL
""")
def ti_yoy(t: Tables) -> DataFrame:
    return _daily_variant(t, "YoY", "yoy")


@query(f"""
WITH {_TOTALS_SQL}
SELECT strftime(day, '%Y-%m-%d') AS day, round((coalesce(total, 0) - py) / py, 6) AS yoy_pct
FROM r WHERE py IS NOT NULL
""")
def ti_yoy_pct(t: Tables) -> DataFrame:
    return _daily_variant(t, "YoY%", "yoy_pct", 6)


@query("""
WITH s AS (SELECT date_trunc('month', o_orderdate)::DATE AS day, sum(o_totalprice) AS total,
                  count(*) AS orders FROM orders GROUP BY 1),
r AS (SELECT s.*, p.total AS py FROM s LEFT JOIN s p ON p.day = (s.day - INTERVAL 1 YEAR)::DATE)
SELECT strftime(day, '%Y-%m-%d') AS day, orders, round(total, 2) AS total,
       round(sum(total) OVER (PARTITION BY year(day) ORDER BY day), 2) AS ytd,
       round(sum(total) OVER (PARTITION BY year(day), quarter(day) ORDER BY day), 2) AS qtd,
       round(total, 2) AS mtd, round(coalesce(py, 0), 2) AS py,
       round(total - coalesce(py, 0), 2) AS yoy, round(coalesce((total - py) / py, 0), 6) AS yoy_pct
FROM r
""")
def ti_all_variants(t: Tables) -> DataFrame:
    """All variants by month of the tagged measure; the other one stays as it is."""
    measures = {
        "Total": Measure(F.sum("o_totalprice")),
        "Orders": Measure(F.count(F.lit(1)), generate_ti=False),
    }
    rows = time_intelligence(t.daily_orders, "day", measures, grain="month")

    def shown(variant: str, digits: int = 2) -> Column:
        value = F.coalesce(F.col(f"`Total {variant}`"), F.lit(0.0))
        return F.round(value, digits)

    return rows.select(
        iso("day").alias("day"), F.col("Orders").alias("orders"), cents(F.col("Total")).alias("total"),
        shown("YTD").alias("ytd"), shown("QTD").alias("qtd"), shown("MTD").alias("mtd"),
        shown("PY").alias("py"), shown("YoY").alias("yoy"), shown("YoY%", 6).alias("yoy_pct"),
    )
