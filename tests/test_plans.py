import datetime as dt
import random

import pytest
from compare import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.plans.bitmaps import (
    count_windows,
    day_bitmaps,
    key_bitmap,
    read_bitmaps,
    window_days,
    write_bitmaps,
)
from lodestar.plans.rolling import (
    days_with_facts,
    rolling_distinct,
    rolling_distinct_trend,
)
from lodestar.plans.running import running_total, running_total_adjusted, years_spanned
from lodestar.plans.sketches import approx_windows, day_sketches, merged_quantiles, run_sketches
from lodestar.plans.time_intelligence import Measure, generated_names, time_intelligence
from lodestar.sources.calendars import calendar_window_bridge, days_between

START = dt.date(2024, 1, 1)
EARLY = dt.date(1969, 12, 1)  # day numbers change sign a month later


def day(n):
    return START + dt.timedelta(days=n)


FACTS = st.lists(st.tuples(st.integers(0, 4) | st.none(), st.integers(0, 70)), min_size=1, max_size=50)


@settings(max_examples=4, deadline=None)
@given(FACTS, st.sampled_from([1, 7, 28]), st.sampled_from([0, -7, 3]))
def test_linear_plan_counts_every_window(spark, facts, size, shift):
    check_windows(spark, facts, size, shift, START)


def test_linear_plan_before_the_epoch(spark):
    facts = [(t, t * 7 + n * n % 71) for t in range(5) for n in range(12)] + [(None, 30)]
    check_windows(spark, facts, 28, 0, EARLY)
    check_windows(spark, facts, 7, -365, EARLY)
    check_windows(spark, facts, 90, 0, EARLY)


def check_windows(spark, facts, size, shift, start):
    def day(n):
        return start + dt.timedelta(days=n)

    df = spark.createDataFrame([(t, day(n)) for t, n in facts], "thing int, d date")
    days = days_between(spark, day(-5), day(470))
    between = (day(-5), day(470))
    counts = rolling_distinct(df, "thing", "d", size, days, shift=shift, between=between)
    got = {r["day"]: r["n"] for r in counts.collect()}
    expected = {}
    for n in range(-5, 471):
        last = n + shift
        seen = {t for t, x in facts if last - size < x <= last}
        if seen:
            expected[day(n)] = len(seen)
    assert got == expected


def test_days_of_the_last_month_and_month_ends(spark):
    facts = [(1, 0), (2, 20), (1, 40), (3, 62)]
    df = spark.createDataFrame([(t, day(n)) for t, n in facts], "thing int, d date")
    extra = spark.createDataFrame([(9, day(65))], "thing int, d date")
    days = days_between(spark, day(10), day(90))
    got = rolling_distinct_trend(df, df.unionByName(extra), "thing", "d", days)
    shown = {r["day"].isoformat(): r["n"] for r in got.collect()}
    # the latest fact of the unfiltered table is on 6 March; January ends with things 2
    # and, from before the selection, none: thing 1 of 1 January is 30 days back
    assert shown == {
        "2024-01-31": 1, "2024-02-29": 1, "2024-03-01": 1, "2024-03-02": 1,
        "2024-03-03": 2, "2024-03-04": 2, "2024-03-05": 2, "2024-03-06": 2,
    }


@settings(max_examples=3, deadline=None)
@given(FACTS)
def test_bridge_equals_linear_plan(spark, facts):
    df = spark.createDataFrame([(t, day(n)) for t, n in facts], "thing int, d date")
    bridge = calendar_window_bridge(days_between(spark, day(-400), day(120)), "day")
    days = days_between(spark, day(5), day(60))
    linear = rows(rolling_distinct_trend(df, df, "thing", "d", days))
    assert rows(rolling_distinct_trend(df, df, "thing", "d", days, by="window", bridge=bridge)) == linear


def test_bridge_shift_counts_earlier_days(spark):
    df = spark.createDataFrame([(1, day(0)), (2, day(3)), (2, day(368))], "thing int, d date")
    bridge = calendar_window_bridge(days_between(spark, day(0), day(400)), "day")
    days = days_between(spark, day(360), day(380))
    got = rolling_distinct_trend(
        df, df, "thing", "d", days, by="window", bridge=bridge, size=7, shift=-365
    )
    shown = {r["window_day"]: r["n"] for r in got.collect()}
    assert shown[day(365)] == 1 and shown[day(368)] == 2 and day(364) not in shown


def test_days_with_facts(spark):
    df = spark.createDataFrame([(1, day(0)), (2, day(0)), (1, None)], "thing int, d date")
    assert rows(days_with_facts(df, "d")) == [(day(0),)]


def test_running_total_carries_forward(spark):
    totals = spark.createDataFrame([(2001, 5.0), (2003, 2.0)], "year int, total double")
    years = spark.range(2000, 2005).select(F.col("id").cast("int").alias("year"))
    got = running_total(totals, "year", "total", years)
    assert rows(got) == [(2001, 5.0), (2002, 5.0), (2003, 7.0), (2004, 7.0)]


def test_adjusted_total_and_zero_divisor(spark):
    fact = spark.createDataFrame([(2001, 1, 10.0), (2001, 1, 20.0), (2002, 2, 5.0), (2003, 3, 8.0)], "fy int, item int, amount double")
    items = spark.createDataFrame([(1, 2.0, 4.0), (2, 1.0, 0.0), (3, 3.0, 1.0)], "id int, discount double, adj double")
    got = running_total_adjusted(
        fact, "fy", F.col("amount"), "item", items, "id", F.col("discount"), F.col("adj"),
        years_spanned(fact, F.col("fy")),
    )
    assert rows(got) == [(2001, 15.0), (2002, 15.0), (2003, 39.0)]


SALES = [
    (dt.date(2023, 2, 28), 10.0), (dt.date(2023, 5, 1), 4.0), (dt.date(2024, 1, 1), 1.0),
    (dt.date(2024, 2, 28), 5.0), (dt.date(2024, 2, 29), 7.0), (dt.date(2024, 5, 1), 6.0),
]


def test_variants_by_day(spark):
    df = spark.createDataFrame(SALES, "d date, v double")
    out = time_intelligence(df, "d", {"S": Measure(F.sum("v")), "N": Measure(F.count("v"), False)})
    assert out.columns == ["day", "S", "N", "S YTD", "S PY", "S YoY", "S YoY%", "S QTD", "S MTD"]
    got = {r["day"]: tuple(r)[1:] for r in out.collect()}
    assert got[dt.date(2024, 2, 29)] == (7.0, 1, 13.0, 10.0, -3.0, -0.3, 13.0, 12.0)
    assert got[dt.date(2024, 2, 28)] == (5.0, 1, 6.0, 10.0, -5.0, -0.5, 6.0, 5.0)
    # a day without facts shows its totals to date
    assert got[dt.date(2024, 4, 30)] == (None, None, 13.0, None, None, None, None, None)
    assert dt.date(2023, 12, 31) in got and dt.date(2024, 5, 2) not in got


def test_variants_by_month(spark):
    df = spark.createDataFrame(SALES, "d date, v double")
    out = time_intelligence(df, "d", {"S": Measure(F.sum("v"))}, ["PY", "YTD"], grain="month")
    got = {r["day"]: (r["S"], r["S PY"], r["S YTD"]) for r in out.collect()}
    assert got[dt.date(2024, 2, 1)] == (12.0, 10.0, 13.0)
    assert got[dt.date(2024, 5, 1)] == (6.0, 4.0, 19.0)


def test_old_variants_are_replaced(spark):
    df = spark.createDataFrame(SALES, "d date, v double")
    measures = {"S": Measure(F.sum("v")), "S YTD": Measure(F.lit(0.0), False)}
    out = time_intelligence(df, "d", measures, ["YTD"])
    assert out.columns == ["day", "S", "S YTD"]
    assert out.filter("`S YTD` = 0").count() == 0
    assert list(generated_names({"S": Measure(F.sum("v"))}, ["PY"])) == ["S PY"]
    with pytest.raises(ValueError, match="unknown"):
        time_intelligence(df, "d", measures, ["WTD"])


@pytest.mark.parametrize("shift", [0, -7])
def test_bitmaps_count_as_marks_do(spark, tmp_path, shift):
    rng = random.Random(shift)
    data = [
        (rng.choice([None, 0, 1, 32768, 32769, 100_000, 7]), dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(150)), rng.choice("ab"))
        for _ in range(400)
    ]
    fact = spark.createDataFrame([*data, (5, None, "a")], "thing long, day date, kind string")
    days = days_with_facts(fact, "day")
    bitmaps = day_bitmaps(fact, "thing", "day", ["kind"])
    path = str(tmp_path / "bitmaps")
    write_bitmaps(bitmaps, path)
    write_bitmaps(bitmaps.filter("day >= '2024-03-01'"), path)
    stored = read_bitmaps(bitmaps, path)
    known = fact.filter("thing is not null")
    windows = window_days(days, 28, shift)

    def counted(rows_, among=None):
        return rows(count_windows(rows_, windows, among))

    assert counted(stored) == rows(rolling_distinct(known, "thing", "day", 28, days, shift=shift))
    some = known.filter("kind = 'a'")
    assert counted(stored.filter("kind = 'a'")) == rows(rolling_distinct(some, "thing", "day", 28, days, shift=shift))
    chosen = spark.createDataFrame([(0,), (32769,), (9,), (None,)], "k long")
    among = known.join(chosen, F.col("thing") == F.col("k"), "left_semi")
    assert counted(stored, key_bitmap(chosen, "k")) == rows(rolling_distinct(among, "thing", "day", 28, days, shift=shift))
    assert counted(stored.limit(0)) == []
    part = read_bitmaps(bitmaps, path, (dt.date(2024, 2, 10), dt.date(2024, 3, 2)))
    assert rows(part.agg(F.min("day"), F.max("day"))) == [(dt.date(2024, 2, 10), dt.date(2024, 3, 2))]


def test_sketches_merge_to_the_whole(spark):
    fact = spark.range(40_000).select(
        F.when(F.col("id") % 100 > 0, F.col("id") % 9_000).alias("thing"), F.date_add(F.lit(START), (F.col("id") % 20).cast("int")).alias("day"),
        (F.col("id") % 1000).alias("v"),
    )
    days = days_with_facts(fact, "day")
    exact = {r["day"]: r["n"] for r in rolling_distinct(fact, "thing", "day", 7, days).collect()}
    got = {r["window"]: r["n"] for r in approx_windows(day_sketches(fact, "thing", "day"), window_days(days, 7)).collect()}
    assert got.keys() == exact.keys() and all(abs(got[d] - exact[d]) <= 0.04 * exact[d] for d in exact)
    one = merged_quantiles(run_sketches(fact, ["day"], "v"), [], {"half": 0.5, "most": 0.9}).first()
    assert one["n"] == 40_000 and one["mean"] == 499.5
    assert abs(one["half"] - 500) <= 30 and abs(one["most"] - 900) <= 30
    assert rows(merged_quantiles(run_sketches(fact.limit(0), ["day"], "v"), ["day"], {"half": 0.5})) == []
