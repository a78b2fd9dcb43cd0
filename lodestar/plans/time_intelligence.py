"""Time-intelligence variants of additive measures, all in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.measures import blank_minus, divide
from lodestar.sources.calendars import days_spanned
from lodestar.sources.staging import stage

# The variants generated for a tagged base measure.
VARIANTS = ("YTD", "PY", "YoY", "YoY%", "QTD", "MTD")


@dataclass(frozen=True)
class Measure:
    """A base measure and whether variants are generated for it."""

    expression: Column
    generate_ti: bool = True


def generated_names(
    measures: Mapping[str, Measure], variants: Sequence[str] = VARIANTS
) -> dict[str, tuple[str, str]]:
    """Variant column name to its base measure and variant."""
    return {
        f"{name} {v}": (name, v)
        for name, m in measures.items()
        if m.generate_ti
        for v in variants
    }


def time_intelligence(
    fact: DataFrame,
    day: str,
    measures: Mapping[str, Measure],
    variants: Sequence[str] = VARIANTS,
    grain: str = "day",
) -> DataFrame:
    """Base measures per day or month with their to-date and prior-year variants.

    The fact is summed per period first, in one pass, and the sums are staged, as the
    calendar and the prior year read them again. Everything after that has one row
    per period of the calendar, also for periods without facts. A given measure that
    bears the name of a generated variant is replaced by it.
    """
    unknown = sorted(set(variants) - set(VARIANTS))
    if unknown:
        raise ValueError(f"unknown variants: {unknown}")
    wanted = generated_names(measures, variants)
    base = {n: m for n, m in measures.items() if n not in wanted}
    wanted = generated_names(base, variants)
    period = F.col(day) if grain == "day" else F.to_date(F.date_trunc(grain, F.col(day)))
    totals = stage(
        fact.groupBy(period.alias("_period")).agg(
            *[m.expression.alias(n) for n, m in base.items()]
        )
    )
    calendar = days_spanned(totals, "_period", grain)
    rows = calendar.join(totals, F.col("day") == F.col("_period"), "left").drop("_period")

    to_date = {
        "YTD": [F.year("day")],
        "QTD": [F.year("day"), F.quarter("day")],
        "MTD": [F.year("day"), F.month("day")],
    }

    def so_far(name: str, variant: str) -> Column:
        w = Window.partitionBy(*to_date[variant]).orderBy("day")
        return F.sum(f"`{name}`").over(w.rowsBetween(Window.unboundedPreceding, 0))

    prior = [n for n, m in base.items() if m.generate_ti]
    if {"PY", "YoY", "YoY%"} & set(variants):
        before = totals.select(
            F.col("_period").alias("_before"),
            *[F.col(f"`{n}`").alias(f"_py_{n}") for n in prior],
        )
        rows = rows.join(before, F.add_months("day", -12) == F.col("_before"), "left")

    def variant(name: str, kind: str) -> Column:
        if kind in to_date:
            return so_far(name, kind)
        now, then = F.col(f"`{name}`"), F.col(f"`_py_{name}`")
        if kind == "PY":
            return then
        change = blank_minus(now, then)
        return change if kind == "YoY" else divide(change, then)

    out = rows.select(
        "day",
        *[F.col(f"`{n}`") for n in base],
        *[variant(n, v).alias(column) for column, (n, v) in wanted.items()],
    )
    shown = [F.col(f"`{c}`").isNotNull() for c in out.columns if c != "day"]
    return out.filter(reduce(Column.__or__, shown))
