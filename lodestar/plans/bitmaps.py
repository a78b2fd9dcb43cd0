"""Distinct counts over stored bitmaps: a window is an OR, a filter of the things an AND.

A bitmap holds 32,768 consecutive keys of one day in 4 KiB, so a day of a million things is
31 rows however many facts it has. Keys are dense longs, such as the surrogate keys of a
registry; a thing that is null needs a key of its own, as rows without a key are left out.
Bitmaps are kept by month, so a query reads the months its windows touch and never the fact.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import quoted
from lodestar.plans.rolling import BLOCK, mark_days

Dates = tuple[dt.date, dt.date]


def _bits(key: Column) -> tuple[Column, Column]:
    """The bucket of a key and the bitmap of all keys of a group."""
    return F.bitmap_bucket_number(key).alias("bucket"), F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("things")


def day_bitmaps(fact: DataFrame, key: str, day: str, by: Sequence[str] = ()) -> DataFrame:
    """The keys that occur on each day: columns ``by``, day, bucket and things.

    ``by`` are attributes that later filters choose values of. Facts are first combined to
    one row per key and eight weeks, so a key with a third of the facts is no burden.
    """
    marks = mark_days(fact.filter(F.col(key).isNotNull()), [*by, key], day)
    number = F.explode(
        F.filter(
            F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.when(F.getbit("_days", i) == 1, i)),
            lambda i: i.isNotNull(),
        )
    )
    pairs = marks.select(*quoted(by), F.col(f"`{key}`").alias("_key"), "_block", number.alias("_at"))
    date = F.date_from_unix_date(F.col("_block") * BLOCK + F.col("_at")).alias("day")
    bucket, things = _bits(F.col("_key"))
    return pairs.groupBy(*quoted(by), date, bucket).agg(things)


def key_bitmap(rows: DataFrame, key: str) -> DataFrame:
    """The keys of a table, as a filter for ``count_windows``: columns bucket and things."""
    bucket, things = _bits(F.col(f"`{key}`"))
    return rows.filter(F.col(f"`{key}`").isNotNull()).groupBy(bucket).agg(things)


def _month(day: Column) -> Column:
    return F.year(day) * 100 + F.month(day)


def write_bitmaps(bitmaps: DataFrame, path: str) -> None:
    """Store bitmaps by month; a month that is written again replaces what it held."""
    bitmaps.withColumn("_month", _month(F.col("day"))).hint("rebalance", "_month", "bucket").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("_month").parquet(path)


def read_bitmaps(bitmaps: DataFrame, path: str, between: Dates | None = None) -> DataFrame:
    """The stored rows with the columns of ``bitmaps``; only months between the dates are read."""
    stored = bitmaps.sparkSession.read.schema(f"{bitmaps.schema.toDDL()}, _month int").parquet(path)
    if between is not None:
        first, last = (d.year * 100 + d.month for d in between)
        stored = stored.filter(F.col("_month").between(first, last) & F.col("day").between(*map(F.lit, between)))
    return stored.drop("_month")


def window_days(days: DataFrame, size: int, shift: int = 0) -> DataFrame:
    """The days (column ``held``) of the window that ends on each date of ``days``."""
    span = F.sequence(F.date_add("day", shift - size + 1), F.date_add("day", shift))
    return days.select("day").distinct().select(F.col("day").alias("window"), F.explode(span).alias("held"))


def count_windows(
    bitmaps: DataFrame, windows: DataFrame, among: DataFrame | None = None, name: str = "n"
) -> DataFrame:
    """Distinct keys on the days (``held``) of each ``window``, only those in ``among`` if given.

    Windows without a key are left out.
    """
    met = bitmaps.select("day", "bucket", "things").join(windows.select("window", "held").distinct(), F.col("day") == F.col("held"))
    found = met.groupBy("window", "bucket").agg(F.bitmap_or_agg("things").alias("things"))
    if among is not None:
        both = found.join(among.select("bucket", F.col("things").alias("_among")), "bucket")
        one = both.select("window", "bucket", F.explode(F.array("things", "_among")).alias("things"))
        found = one.groupBy("window", "bucket").agg(F.bitmap_and_agg("things").alias("things"))
    counted = found.groupBy("window").agg(F.sum(F.bitmap_count("things")).alias(name))
    return counted.filter(F.col(name) > 0)
