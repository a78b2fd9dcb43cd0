"""Smaller models: fewer distinct values for data nobody looks up any more."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The stand-ins for historical members.
HISTORICAL_KEY = "Historical Key"
HISTORICAL_CUSTOMER = "Historical Customer"
HISTORICAL_CUSTOMER_KEY = -1


def latest_start(fact: DataFrame, day: str, unit: str) -> Column:
    """First day of the latest year or month in the fact, as a scalar subquery."""
    start = F.to_date(F.date_trunc(unit, F.max(day)))
    return fact.agg(start.alias("start")).scalar()


def last_n_years(fact: DataFrame, day: str, years: int) -> DataFrame:
    """Rows of the last n years up to the latest date."""
    start = fact.agg(F.add_months(F.max(day), -12 * years).alias("start")).scalar()
    return fact.filter(F.col(day) > start)


def historical_key(fact: DataFrame, key: str, day: str, cutoff: Column) -> DataFrame:
    """Replace the keys of rows before the cutoff by one text value."""
    text = F.col(key).cast("string")
    replaced = F.when(F.col(day) < cutoff, HISTORICAL_KEY).otherwise(text)
    return fact.withColumn(key, replaced)


def historical_attributes(
    dim: DataFrame,
    dim_key: str,
    defaults: Mapping[str, object],
    fact: DataFrame,
    fact_key: str,
    day: str,
    cutoff: Column,
) -> DataFrame:
    """Give members that only have rows before the cutoff default attributes."""
    last = fact.groupBy(F.col(fact_key).alias("_key")).agg(F.max(day).alias("_last"))
    joined = dim.join(last, F.col(dim_key) == F.col("_key"), "left")
    old = F.col("_last") < cutoff
    return joined.select(
        *[
            F.when(old, F.lit(defaults[c])).otherwise(F.col(c)).cast(dim.schema[c].dataType).alias(c)
            if c in defaults
            else F.col(c)
            for c in dim.columns
        ]
    )


def historical_member_fact(
    fact: DataFrame, key: str, day: str, cutoff: Column
) -> DataFrame:
    """Point the rows before the cutoff to the historical member."""
    member = F.lit(HISTORICAL_CUSTOMER_KEY).cast(fact.schema[key].dataType)
    return fact.withColumn(key, F.when(F.col(day) < cutoff, member).otherwise(F.col(key)))


def historical_member_dim(
    dim: DataFrame,
    dim_key: str,
    name: str,
    fact: DataFrame,
    fact_key: str,
    day: str,
    cutoff: Column,
) -> DataFrame:
    """Keep members with rows that are not old and add the historical member.

    A row is old when its day is before the cutoff; a row without a day is not. Every key
    of the remapped fact is found in the result.
    """
    old = F.coalesce(F.col(day) < cutoff, F.lit(False))
    recent = fact.filter(~old).select(F.col(fact_key).alias("_key")).distinct()
    kept = dim.join(recent, F.col(dim_key) == F.col("_key"), "left_semi")
    values = {dim_key: HISTORICAL_CUSTOMER_KEY, name: HISTORICAL_CUSTOMER}
    member = dim.sparkSession.range(1).select(
        *[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in dim.schema]
    )
    return kept.unionByName(member)


def column_statistics(
    df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False
) -> DataFrame:
    """Cardinality, nulls and text size of each column, with its share of the size.

    By default one pass with a small sketch per column. The exact form counts each
    column's values on its own, so a frequent value is combined before the shuffle.
    """
    columns = list(columns or df.columns)

    def size(c: Column) -> Column:
        return F.coalesce(F.octet_length(c.cast("string")), F.lit(0)).cast("long")

    if exact:
        cells = F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns
        ])
        # one scan: a frequent value of a column is combined before the shuffle
        values = df.select(F.inline(cells)).groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
        stats = values.groupBy("column").agg(
            F.count("v").alias("cardinality"),
            F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            F.coalesce(F.sum(size(F.col("v")) * F.col("n")), F.lit(0)).alias("size"),
        )
    else:
        cells = [
            (c, F.approx_count_distinct(f"`{c}`", 0.02), F.count_if(F.col(f"`{c}`").isNull()),
             F.coalesce(F.sum(size(F.col(f"`{c}`"))), F.lit(0)))
            for c in columns
        ]
        one = df.agg(
            *[
                F.struct(
                    F.lit(c).alias("column"), n.alias("cardinality"),
                    m.alias("nulls"), s.alias("size"),
                ).alias(f"_{i}")
                for i, (c, n, m, s) in enumerate(cells)
            ]
        )
        stats = one.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(cells))])))
    # one row per column is left
    total = F.sum("size").over(Window.partitionBy())
    return stats.withColumn("share", F.try_divide(F.col("size"), total))
