"""Rolling distinct counts.

The days of a thing are kept as bits of a long, 56 days per row, by a plain
aggregate. However often a thing occurs, it crosses the shuffle as one small row per
eight weeks and task.

The linear plan costs the same for any window size. A day makes its thing count until
the window has passed or the thing occurs again; the ends of these stretches are
summed per date and added up along the calendar. The bridge plan joins the bits of the
things to the bits of the windows of a stored table and serves any window table.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.dates import end_of_month
from lodestar.sources.staging import stage

BLOCK = 56  # days per row: seven bytes, so the sign bit of a long stays free

Dates = tuple[dt.date, dt.date]


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def _shifted(bits: Column, by: Column) -> Column:
    return F.call_function("shiftright", bits, by)


def _lowest(bits: Column) -> Column:
    """Position of the lowest set bit."""
    return F.bit_count(bits.bitwiseAND(-bits) - 1)


def _as_marks(day: Column) -> tuple[Column, Column]:
    """Block of a date and its bit within the block."""
    number = F.unix_date(day)
    return F.floor(number / BLOCK).cast("int").alias("_block"), F.bit_or(
        _bit(F.pmod(number, F.lit(BLOCK)))
    ).alias("_days")


def mark_days(
    fact: DataFrame,
    by: Sequence[str],
    day: str,
    between: Dates | None = None,
    size: int = 1,
    shift: int = 0,
) -> DataFrame:
    """The days on which each combination of keys occurs, as bits of ``_days``.

    The result has the key columns, ``_block`` and ``_days``, so filters on the keys can
    follow. With ``between``, the first and last result date, only days that a window of
    the size and shift can hold are read.
    """
    rows = fact.filter(F.col(day).isNotNull())
    if between is not None:
        first = between[0] + dt.timedelta(days=shift - size + 1)
        last = between[1] + dt.timedelta(days=shift)
        rows = rows.filter(F.col(day).between(F.lit(first), F.lit(last)))
    block, days = _as_marks(F.col(day))
    return rows.groupBy(*by, block).agg(days)


def count_marked(
    marks: DataFrame,
    thing: str,
    size: int,
    days: DataFrame,
    name: str = "n",
    shift: int = 0,
) -> DataFrame:
    """Rolling distinct count over the result of :func:`mark_days`."""
    merged = marks.groupBy(thing, "_block").agg(F.bit_or("_days").alias("_days"))
    # a thing has one row per block of the calendar
    base = F.col("_block") * BLOCK
    later = F.lead(base + _lowest(F.col("_days"))).over(
        Window.partitionBy(thing).orderBy("_block")
    )
    bits, at = F.col("_days"), F.col("_at")
    bytes_set = (
        merged.withColumn("_later", later)
        .withColumn("_byte", F.explode(F.array(*[F.lit(8 * i) for i in range(7)])))
        .filter(_shifted(bits, F.col("_byte")).bitwiseAND(F.lit(255)) != 0)
    )
    single = (
        bytes_set.withColumn("_i", F.explode(F.array(*[F.lit(i) for i in range(8)])))
        .select("_days", "_later", base.alias("_base"), (F.col("_byte") + F.col("_i")).alias("_at"))
        .filter(_shifted(bits, at).bitwiseAND(F.lit(1)) == 1)
    )
    here = F.col("_base") + at
    rest = _shifted(bits, at + 1)
    again = F.when(rest != 0, here + 1 + _lowest(rest)).otherwise(F.col("_later"))
    edges = single.select(
        F.inline(
            F.array(
                F.struct((here - shift).alias("_number"), F.lit(1).alias("_change")),
                F.struct(
                    (F.least(here + size, again) - shift).alias("_number"),
                    F.lit(-1).alias("_change"),
                ),
            )
        )
    )
    changes = edges.groupBy("_number").agg(F.sum("_change").alias("_change"))
    wanted = days.select(
        F.unix_date("day").alias("_number"), F.lit(0).cast("long").alias("_change"),
        F.lit(True).alias("_wanted"),
    )
    timeline = (
        changes.withColumn("_wanted", F.lit(False)).unionByName(wanted)
        .groupBy("_number").agg(F.sum("_change").alias("_change"), F.max("_wanted").alias("_wanted"))
    )
    # one row per calendar day is left, so this window is small however large the fact
    running = F.sum("_change").over(
        Window.orderBy("_number").rowsBetween(Window.unboundedPreceding, 0)
    )
    counted = timeline.select(
        F.date_from_unix_date("_number").alias("day"), "_wanted", running.alias(name)
    )
    return counted.filter(F.col("_wanted") & (F.col(name) > 0)).select("day", name)


def rolling_distinct(
    fact: DataFrame,
    thing: str,
    day: str,
    size: int,
    days: DataFrame,
    name: str = "n",
    shift: int = 0,
    between: Dates | None = None,
) -> DataFrame:
    """Distinct things in the ``size`` days up to each date of ``days`` (column ``day``).

    Null is one more thing. A shift moves the counted days away from the date:
    -365 counts the window of a year earlier. Dates with nothing to count are left
    out; facts before the first date still count.
    """
    marks = mark_days(fact, [thing], day, between, size, shift)
    return count_marked(marks, thing, size, days, name, shift)


def _count_met(marks: DataFrame, thing: str, pieces: DataFrame, by: str, name: str) -> DataFrame:
    """Distinct things per window: ``pieces`` has the days of each window as bits by block.

    The pieces are written first, so Spark knows their size and sends them to all tasks when
    they are few, as they are for some dozens of windows.
    """
    met = marks.join(stage(pieces), "_block").filter(F.col("_days").bitwiseAND(F.col("_held")) != 0)
    pairs = met.select(by, thing).distinct()
    return pairs.groupBy(by).agg(F.count(F.lit(1)).alias(name))


def count_marked_on(
    marks: DataFrame, thing: str, size: int, days: DataFrame, name: str = "n", shift: int = 0
) -> DataFrame:
    """As :func:`count_marked`, for few dates: the bits of things meet the bits of windows."""
    held_days = F.sequence(F.date_add("day", shift - size + 1), F.date_add("day", shift))
    spans = days.select("day").distinct().select("day", F.explode(held_days).alias("_key"))
    block, held = _as_marks(F.col("_key"))
    return _count_met(marks, thing, spans.groupBy("day", block).agg(held.alias("_held")), "day", name)


def append_marks(marks: DataFrame, path: str) -> None:
    """Add marks to a stored table, in folders by block; a period is appended once it is over."""
    marks.hint("rebalance", "_block").write.mode("append").partitionBy("_block").parquet(path)


def read_marks(marks: DataFrame, path: str, between: Dates | None = None) -> DataFrame:
    """The stored marks with the columns of ``marks``; only blocks between the dates are read."""
    stored = marks.sparkSession.read.schema(marks.schema).parquet(path)
    if between is None:
        return stored
    epoch = dt.date(1970, 1, 1)
    first, last = ((d - epoch).days // BLOCK for d in between)
    return stored.filter(F.col("_block").between(first, last))


def days_with_facts(fact: DataFrame, day: str) -> DataFrame:
    """The dates that occur in a fact, in column ``day``."""
    return fact.select(F.col(day).alias("day")).filter("day is not null").distinct()


def reported(date: Column, last: Column) -> Column:
    """Dates up to ``last`` in its month, and the month ends before."""
    return (date <= last) & (
        (date > end_of_month(last, -1)) | (date == end_of_month(date))
    )


def _last_fact_day(fact: DataFrame, day: str, days: DataFrame) -> Column:
    inside = days_with_facts(fact, day).join(days, "day", "left_semi")
    return inside.agg(F.max("day").alias("last")).scalar()


def month_end_days(unfiltered: DataFrame, day: str, days: DataFrame) -> DataFrame:
    """The days of the last month and the earlier month ends of a selection.

    ``days`` are the selected calendar days, with or without facts. The last month
    is that of the latest selected day in ``unfiltered``, the fact without the
    filters of its dimensions.
    """
    return days.filter(reported(F.col("day"), _last_fact_day(unfiltered, day, days)))


def count_marked_by_window(
    marks: DataFrame,
    unfiltered: DataFrame,
    thing: str,
    day: str,
    bridge: DataFrame,
    days: DataFrame,
    size: int = 28,
    shift: int = 0,
    name: str = "n",
) -> DataFrame:
    """The month-end measure by window date, through a stored calendar window bridge.

    Windows start no earlier than the first selected day.
    """
    last = _last_fact_day(unfiltered, day, days)
    first = days.agg(F.min("day").alias("first")).scalar()
    windows = bridge.filter(
        (F.col("WindowDaySize") == size)
        & (F.col("WindowDayShift") == shift)
        & (F.col("Window") >= first)
        & reported(F.col("Window"), last)
    )
    block, held = _as_marks(F.col("DIM_CalendarKey"))
    pieces = windows.groupBy("Window", block).agg(held.alias("_held"))
    return _count_met(marks, thing, pieces.withColumnRenamed("Window", "window_day"), "window_day", name)


def rolling_distinct_trend(
    fact: DataFrame,
    unfiltered: DataFrame,
    thing: str,
    day: str,
    days: DataFrame,
    by: str = "day",
    bridge: DataFrame | None = None,
    size: int = 28,
    shift: int = 0,
    name: str = "n",
    between: Dates | None = None,
) -> DataFrame:
    """One measure for both groupings: by calendar ``day`` or by bridge ``window``.

    Counts the things of ``fact`` on the days of the last selected month and on the
    month ends before it; see :func:`month_end_days` for the other arguments.
    """
    marks = mark_days(fact, [thing], day, between, size, shift)
    if by == "window":
        return count_marked_by_window(
            marks, unfiltered, thing, day, bridge, days, size, shift, name
        )
    return count_marked_on(marks, thing, size, month_end_days(unfiltered, day, days), name, shift)
