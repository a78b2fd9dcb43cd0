"""Running totals by fiscal year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.measures import divide
from lodestar.operators.measures import sum_over_related


def years_spanned(fact: DataFrame, year: Column) -> DataFrame:
    """Every year from the first to the last one of the fact, in column ``year``."""
    ends = fact.select(year.alias("y")).agg(F.min("y").alias("a"), F.max("y").alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias("year"))


def running_total(totals: DataFrame, year: str, total: str, years: DataFrame) -> DataFrame:
    """Running total over all years; a year without facts carries the total forward.

    ``totals`` has one row per year. Years before the first fact are left out.
    """
    spine = years.select(F.col("year").alias("_year"))
    joined = spine.join(totals, F.col("_year") == F.col(year), "left")
    # one row per year
    w = Window.orderBy("_year").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(
        F.col("_year").alias(year), F.sum(total).over(w).alias("running_total")
    ).filter(F.col("running_total").isNotNull())


def running_total_adjusted(
    fact: DataFrame,
    year: str,
    amount: Column,
    item: str,
    items: DataFrame,
    items_key: str,
    discount: Column,
    adjustment: Column,
    years: DataFrame,
) -> DataFrame:
    """Running total of amounts weighted by their item's discount / adjustment."""
    totals = sum_over_related(
        fact, [year], item, amount, items, items_key, divide(discount, adjustment), "_total"
    )
    return running_total(totals, year, "_total", years)
