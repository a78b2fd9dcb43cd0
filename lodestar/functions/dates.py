"""Date functions on columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.text import _col


def end_of_month(day: Column | str, months: int = 0) -> Column:
    """Last day of the month that lies ``months`` away from the day's month."""
    return F.last_day(F.add_months(_col(day), months))


def fiscal_year(day: Column | str, first_month: int = 7) -> Column:
    """Fiscal year named after the calendar year in which it ends."""
    return F.year(F.add_months(_col(day), (13 - first_month) % 12))


def age_bucket(moment: Column | str, now: Column) -> Column:
    """``today``, ``yesterday`` or ``n days ago`` by whole days up to ``now``."""
    days = F.timestamp_diff("DAY", _col(moment), now)
    return (
        F.when(days == 0, "today")
        .when(days == 1, "yesterday")
        .otherwise(F.concat(days.cast("string"), F.lit(" days ago")))
    )


def local_moment(value: dt.datetime, kind: T.DataType | str = "timestamp_ntz") -> Column:
    """A local date and time as a literal, whatever zone this process runs in."""
    return F.lit(value.isoformat(sep=" ")).cast(kind)


def shift_hours(moment: Column | str, hours: int) -> Column:
    """The moment moved by whole hours."""
    return _col(moment) + F.make_dt_interval(F.lit(0), F.lit(hours))


def month_name(day: Column | str) -> Column:
    """Three-letter month name."""
    return F.date_format(_col(day), "MMM")


def quarter_name(day: Column | str) -> Column:
    """``Q1`` to ``Q4``."""
    return F.concat(F.lit("Q"), F.quarter(_col(day)).cast("string"))
