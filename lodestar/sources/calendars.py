"""Generated calendars. Their size is set by the date range, not by the facts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.dates import month_name, quarter_name

# The window sizes and shifts of the calendar window bridge.
WINDOW_DAY_SIZES = (28, 7)
WINDOW_DAY_SHIFTS = (0, -7, -28, -365)


def days_between(spark: SparkSession, first: dt.date | None, last: dt.date | None) -> DataFrame:
    """One row per day, both ends included, in column ``day``; none without ends."""
    day = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return spark.range(1).select(day.alias("day"))


def date_bounds(df: DataFrame, day: str) -> tuple[dt.date | None, dt.date | None]:
    """First and last date of a column, read once; None for an empty one."""
    return tuple(df.agg(F.min(day), F.max(day)).first())


def days_spanned(df: DataFrame, day: str, unit: str = "day") -> DataFrame:
    """One row per day (or month, year) from the first to the last date of a column."""
    step = F.expr(f"interval 1 {unit}")
    start = F.to_date(F.date_trunc(unit, F.col(day))) if unit != "day" else F.col(day)
    ends = df.select(start.alias("d")).agg(F.min("d").alias("a"), F.max("d").alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", step)).alias("day"))


def date_dimension(days: DataFrame, day: str = "day") -> DataFrame:
    """Year, month name, month number and quarter of every day."""
    return days.select(
        F.col(day).alias("Date"),
        F.year(day).alias("Year"),
        month_name(day).alias("Month"),
        F.month(day).alias("Month Number"),
        quarter_name(day).alias("Quarter"),
    )


def calendar_window_bridge(
    calendar: DataFrame,
    day: str,
    sizes: Sequence[int] = WINDOW_DAY_SIZES,
    shifts: Sequence[int] = WINDOW_DAY_SHIFTS,
) -> DataFrame:
    """Every date with the windows that hold it, for all sizes and shifts.

    A window of size n ends on its own date and reaches n days back, itself
    included; a shift moves the dates, not the window.
    """
    size, shift = F.col("WindowDaySize"), F.col("WindowDayShift")
    return (
        calendar.select(
            F.col(day).alias("_day"),
            F.explode(F.array(*[F.lit(s) for s in sizes])).alias("WindowDaySize"),
        )
        .select("*", F.explode(F.array(*[F.lit(s) for s in shifts])).alias("WindowDayShift"))
        .select("*", F.explode(F.sequence(F.lit(0), size - 1)).alias("_ahead"))
        .select(
            F.date_add("_day", shift).alias("DIM_CalendarKey"),
            F.date_add("_day", F.col("_ahead")).alias("Window"),
            size,
            shift,
        )
    )
