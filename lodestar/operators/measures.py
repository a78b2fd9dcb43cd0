"""Measures by group, and filters on measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import quoted
from lodestar.functions.measures import divide
from lodestar.operators.joins import join_and_expand

# Rating and stoplight labels with their order.
RATINGS = (("Low", 0), ("Medium-Low", 1), ("Medium", 2), ("Medium-High", 3), ("High", 4))
STOPLIGHT = (("Green", 1), ("Yellow", 2), ("Red", 3))


def summarize_columns(
    df: DataFrame, by: Sequence[str | Column], measures: Mapping[str, Column]
) -> DataFrame:
    """Measures per group, without the groups whose measures are all blank."""
    out = df.groupBy(*by).agg(*[m.alias(n) for n, m in measures.items()])
    some = [F.col(f"`{n}`").isNotNull() for n in measures]
    return out.filter(reduce(Column.__or__, some))


def existing_combinations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Combinations of values that occur."""
    return df.select(*quoted(columns)).distinct()


def sum_over_related(
    fact: DataFrame,
    by: Sequence[str],
    key: str,
    amount: Column,
    dim: DataFrame,
    dim_key: str,
    factor: Column,
    name: str,
) -> DataFrame:
    """Sum of amount times a factor of the related dimension row.

    The factor is the same for all rows of a key, so amounts are summed per group
    and key before the join: a frequent key crosses the shuffle as one row per task.
    """
    sums = fact.groupBy(*quoted(by), key).agg(F.sum(amount).alias("_amount"))
    factors = dim.select(F.col(dim_key).alias("_dim_key"), factor.alias("_factor"))
    joined = join_and_expand(sums, factors, [key], ["_factor"], target_on=["_dim_key"])
    return joined.groupBy(*quoted(by)).agg(F.sum(F.col("_amount") * F.col("_factor")).alias(name))


def sum_by_item(
    rows: DataFrame,
    by: Sequence[str],
    item: str,
    amount: Column,
    numerator: Column,
    divisor: Column,
    name: str,
) -> DataFrame:
    """Two-level sum: per item the summed amount times the ratio of two maxima."""
    items = rows.groupBy(*quoted(by), item).agg(
        F.sum(amount).alias("_amount"),
        F.max(numerator).alias("_numerator"),
        F.max(divisor).alias("_divisor"),
    )
    weighted = F.col("_amount") * divide("_numerator", "_divisor")
    return items.groupBy(*quoted(by)).agg(F.sum(weighted).alias(name))


def count_non_null(df: DataFrame, by: Sequence[str | Column], column: str) -> DataFrame:
    """Non-null count per group, largest first."""
    return (
        df.groupBy(*by).agg(F.count(column).alias(f"Count of {column}"))
        .orderBy(F.desc(f"Count of {column}"))
    )


def include_or_exclude(flag: str, column: str, value: object) -> Column:
    """Keep every row on ``Yes``; otherwise drop the rows with the value, keep nulls."""
    return F.lit(flag == "Yes") | ~F.col(column).eqNullSafe(F.lit(value))


def first_n(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """The first n rows in a given order."""
    return df.orderBy(*order).limit(n)


def top_n(groups: DataFrame, measure: str, n: int) -> DataFrame:
    """Groups with the n largest measures; ties with the last one are kept."""
    # every task keeps its own n first, so the one window sees few rows
    place = F.rank().over(Window.orderBy(F.desc(measure)))
    ranked = groups.filter(F.col(measure).isNotNull()).withColumn("_place", place)
    return ranked.filter(F.col("_place") <= n).drop("_place")


def above(groups: DataFrame, measure: str, bound: float, hide: bool = True) -> DataFrame:
    """Groups whose measure exceeds a constant; the measure itself can be hidden."""
    kept = groups.filter(F.col(measure) > F.lit(bound))
    return kept.drop(measure) if hide else kept


def above_average(groups: DataFrame, measure: str) -> DataFrame:
    """Groups whose measure exceeds the average of the measure over all groups."""
    average = groups.agg(F.avg(measure).alias("average")).scalar()
    return groups.filter(F.col(measure) > average)


def what_if_grid(
    groups: DataFrame, measure: str, low: float, high: float, step: float
) -> DataFrame:
    """The measure under every value of a numeric parameter: measure x (1 + value).

    The parameter values are ``low``, ``low + step``, ... up to ``high``.
    """
    count = int(round((high - low) / step))
    value = F.round(F.lit(low) + F.col("_step") * F.lit(step), 10)
    return (
        groups.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(count))))
        .select(
            *[F.col(f"`{c}`") for c in groups.columns],
            value.alias("parameter"),
            (F.col(measure) * (1 + value)).alias("adjusted"),
        )
    )


def band(
    groups: DataFrame,
    measure: str,
    labels: Sequence[tuple[str, int]],
    bounds: Sequence[float],
) -> DataFrame:
    """Label each group by ascending lower bounds of all labels but the first.

    Adds ``label`` and ``label_order``; labels come in order of rising measure.
    """
    if len(bounds) != len(labels) - 1:
        raise ValueError("one bound fewer than labels is needed")

    def ladder(values: Sequence[object]) -> Column:
        label = F.when(F.col(measure).isNotNull(), F.lit(values[0]))
        for value, bound in zip(values[1:], bounds, strict=True):
            label = F.when(F.col(measure) >= bound, F.lit(value)).otherwise(label)
        return label

    return groups.select(
        "*",
        ladder([t for t, _ in labels]).alias("label"),
        ladder([o for _, o in labels]).alias("label_order"),
    )


def next_years(totals: DataFrame, year: str, selected: int, n: int) -> DataFrame:
    """The n years after the selected one."""
    return totals.filter(F.col(year).between(selected + 1, selected + n))


def by_date_grain(df: DataFrame, day: str, grain: str, measures: Mapping[str, Column]) -> DataFrame:
    """Measures by a date grain chosen at run time: Year, Quarter, Month or Day."""
    units = {"Year": "year", "Quarter": "quarter", "Month": "month", "Day": "day"}
    period = F.to_date(F.date_trunc(units[grain], F.col(day)))
    return df.groupBy(period.alias("period")).agg(
        *[m.alias(n) for n, m in measures.items()]
    )


# --- stores and row-level security ---------------------------------------------

# Fixed value: the display label of the signed-in user's own store.
HOME_STORE = "Home Store"


def store_display(stores: DataFrame, store: str, homes: Sequence[str]) -> DataFrame:
    """Every store as seen from the given home stores, with label and sort column.

    One row per store and listed home; the home store is labelled ``Home Store``
    and sorts first. The full product of all stores with all stores is never built.
    """
    home = F.explode(F.array(*[F.lit(h) for h in homes]))
    rows = stores.select(F.col(store).alias("store"), home.alias("home_store"))
    own = F.col("store") == F.col("home_store")
    return rows.select(
        "home_store",
        "store",
        F.when(own, HOME_STORE).otherwise(F.col("store")).alias("display"),
        F.when(own, F.lit("")).otherwise(F.col("store")).alias("display_sort"),
    )


def visible_sales(
    sales: DataFrame,
    store: str,
    users: DataFrame,
    user: str,
    label: str | None = None,
) -> DataFrame:
    """Sales rows the user sees under a display label.

    ``users`` has columns ``user`` and ``home_store``. With the label ``Home Store``
    the filter runs from user to home store to sales; with the name of another
    store to that store; without a label a known user sees all sales.
    """
    own = users.filter(F.col("user") == user).select(F.col("home_store").alias("_home"))
    known = own.limit(1)
    if label == HOME_STORE:
        return sales.join(own, F.col(store) == F.col("_home"), "left_semi")
    if label is not None:
        # a home store of the user carries the label, not its own name
        seen = own.agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("_home") != label).alias("m")
        ).select((F.col("m") > 0).alias("seen"))
        return sales.filter((F.col(store) == label) & seen.scalar())
    return sales.filter(known.agg((F.count(F.lit(1)) > 0).alias("known")).scalar())


def home_store_sales(
    totals: DataFrame, store: str, users: DataFrame
) -> DataFrame:
    """What each user sees under ``Home Store``: their own store's totals."""
    return users.join(totals, F.col("home_store") == F.col(store)).drop(store)
