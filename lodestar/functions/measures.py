"""Aggregate expressions with the BLANK rules of a tabular model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.text import _col


def distinct_count(c: Column | str) -> Column:
    """Number of distinct values, where null counts as one value."""
    c = _col(c)
    return F.count_distinct(c) + F.coalesce(
        F.max(c.isNull().cast("int")), F.lit(0)
    ).cast("long")


def approx_distinct_count(c: Column | str, rsd: float = 0.02) -> Column:
    """Approximate form of :func:`distinct_count` with one small sketch per group."""
    c = _col(c)
    return F.approx_count_distinct(c, rsd) + F.coalesce(
        F.max(c.isNull().cast("int")), F.lit(0)
    ).cast("long")


def selected_value(c: Column | str, alternate: Column | None = None) -> Column:
    """The only value of the group, or the alternate (null) when there are several."""
    c = _col(c)
    # min = max tells a single value without the expansion a distinct count needs
    single = F.min(c).eqNullSafe(F.max(c)) & (
        (F.count(c) == F.count(F.lit(1))) | (F.count(c) == 0)
    )
    return F.when(single, F.max(c)).otherwise(
        F.lit(None) if alternate is None else alternate
    )


def divide(a: Column | str, b: Column | str, alternate: Column | None = None) -> Column:
    """Division that gives null (or the alternate) where the divisor is zero or null."""
    quotient = F.try_divide(_col(a), _col(b))
    return quotient if alternate is None else F.coalesce(quotient, alternate)


def blank_minus(a: Column, b: Column) -> Column:
    """Subtraction where one blank operand counts as zero and two give blank."""
    zero = F.lit(0)
    return F.when(
        a.isNotNull() | b.isNotNull(), F.coalesce(a, zero) - F.coalesce(b, zero)
    )


def is_not(c: Column | str, value: object) -> Column:
    """``<>`` that keeps rows whose value is null."""
    return ~_col(c).eqNullSafe(F.lit(value))
