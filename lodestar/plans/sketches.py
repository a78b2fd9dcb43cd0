"""Stored sketches that merge: approximate distinct counts and quantiles over any period.

A sketch of a day, or of a run, has a fixed size whatever it stands for, so a window or a
history merges a few rows and never reads the facts. Counts have a relative standard error of
about 1.04 / sqrt(2^bits); ranks of quantiles about 1.3 % at the default accuracy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import quoted

BITS = 14
# The runs of a group merge in so many shares first.
_SHARES = 256


def day_sketches(fact: DataFrame, thing: str, day: str, by: Sequence[str] = (), bits: int = BITS) -> DataFrame:
    """One sketch of the things per day and attributes ``by``; null is one more thing."""
    known = F.coalesce(F.concat(F.lit("="), F.col(f"`{thing}`").cast("string")), F.lit(""))
    return (
        fact.filter(F.col(day).isNotNull()).groupBy(*quoted(by), F.col(day).alias("day"))
        .agg(F.hll_sketch_agg(known, bits).alias("things"))
    )


def approx_windows(sketches: DataFrame, windows: DataFrame, name: str = "n") -> DataFrame:
    """Estimated distinct things on the days (``held``) of each ``window``."""
    met = sketches.select("day", "things").join(windows.select("window", "held").distinct(), F.col("day") == F.col("held"))
    return met.groupBy("window").agg(F.hll_sketch_estimate(F.hll_union_agg("things")).alias(name))


def run_sketches(log: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per run and whatever else is in ``by``: rows, sum and a quantile sketch of a value.

    Nulls are left out; a group without values is too.
    """
    v = F.col(f"`{value}`").cast("double")
    return log.filter(v.isNotNull()).groupBy(*quoted(by)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.kll_sketch_agg_double(v).alias("sketch")
    )


def _merged(sketches: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """One sketch a group, of rows (n, _total, sketch)."""
    whole = F.aggregate(F.slice("_all", 2, 1 << 30), F.col("_all")[0], lambda a, b: F.kll_sketch_merge_double(a, b))
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("_total").alias("_total"), F.collect_list("sketch").alias("_all")
    ).withColumn("sketch", whole).drop("_all")


def merged_quantiles(sketches: DataFrame, by: Sequence[str], ranks: dict[str, float]) -> DataFrame:
    """Rows, mean and named quantiles over all runs of each group, from their sketches."""
    share = F.pmod(F.xxhash64("sketch"), F.lit(_SHARES)).alias("_share")
    merged = _merged(_merged(sketches.withColumnRenamed("total", "_total"), [*quoted(by), share]), quoted(by))

    def quantile(rank: float, name: str) -> Column:
        return F.kll_sketch_get_quantile_double("sketch", F.lit(rank)).alias(name)

    return merged.select(
        *quoted(by), "n", (F.col("_total") / F.col("n")).alias("mean"), *[quantile(r, c) for c, r in ranks.items()]
    )
