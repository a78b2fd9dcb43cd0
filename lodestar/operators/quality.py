"""Data-quality tests that fail on purpose."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import quoted


class DataQualityError(ValueError):
    """A data-quality test has failed."""


def require(df: DataFrame, condition: Column, message: Column | str) -> DataFrame:
    """Raise when any row breaks the condition; the message may show row values.

    Null counts as broken. One aggregate over the columns in use.
    """
    text = F.lit(message) if isinstance(message, str) else message
    broken = ~F.coalesce(condition, F.lit(False))
    found = df.agg(
        F.count_if(broken).alias("n"), F.min(F.when(broken, text)).alias("example")
    ).first()
    if found["n"]:
        raise DataQualityError(f"{found['n']} rows: {found['example']}")
    return df


def require_in_plan(df: DataFrame, condition: Column, message: Column | str) -> DataFrame:
    """The same test as part of the plan: the job that reads the rows fails."""
    text = F.lit(message) if isinstance(message, str) else message
    failed = F.raise_error(text).cast("boolean")
    return df.filter(F.when(F.coalesce(condition, F.lit(False)), True).otherwise(failed))


def repeated(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count ``n``."""
    return df.groupBy(*quoted(key)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def require_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Raise when a key occurs more than once, naming a few of them."""
    found = repeated(df, key).limit(3).collect()
    if found:
        raise DataQualityError(f"key {list(key)} is not unique: {found}")
    return df


def many_values(df: DataFrame, determinant: Sequence[str], dependent: str) -> DataFrame:
    """Determinant values with more than one dependent value (null is a value)."""
    pairs = df.select(*determinant, dependent).distinct()
    return pairs.groupBy(*quoted(determinant)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def require_one_to_many(df: DataFrame, one: Sequence[str], dependent: str) -> DataFrame:
    """Raise when a value of ``one`` goes with several values of ``dependent``."""
    found = many_values(df, one, dependent).limit(3).collect()
    if found:
        raise DataQualityError(f"{list(one)} does not determine {dependent}: {found}")
    return df


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with its number of nulls."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls"))
                    for c in columns
                ]
            )
        )
    )


def require_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Raise when any of the columns holds a null."""
    found = null_counts(df, columns).filter("nulls > 0").collect()
    if found:
        raise DataQualityError(f"unexpected nulls: {[tuple(r) for r in found]}")
    return df


@dataclass(frozen=True)
class Check:
    """A row test with its failure mode: ``abort``, ``skip`` or ``continue``."""

    name: str
    condition: Column
    failure_mode: str = "abort"


def check_report(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """All checks in one pass: rows, violations and outcome of each, in order.

    A failed ``skip`` check marks the checks after it as ``skipped``; a failed
    ``abort`` check marks them ``aborted``; ``continue`` only warns.
    """
    modes = {"abort", "skip", "continue"}
    if not {c.failure_mode for c in checks} <= modes:
        raise ValueError(f"failure modes are {sorted(modes)}")
    broken = [
        F.count_if(~F.coalesce(c.condition, F.lit(False))).alias(f"_{i}")
        for i, c in enumerate(checks)
    ]
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *broken)
    stopped = F.lit(None).cast("string")
    lines = []
    for i, c in enumerate(checks):
        n = F.col(f"_{i}")
        outcome = F.when(
            stopped.isNotNull(), stopped
        ).when(n == 0, "passed").otherwise(
            "warning" if c.failure_mode == "continue" else "failed"
        )
        lines.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(c.name).alias("check"),
                F.lit(c.failure_mode).alias("failure_mode"),
                F.col("_rows").alias("rows"), n.alias("violations"),
                outcome.alias("outcome"),
            )
        )
        if c.failure_mode != "continue":
            after = "skipped" if c.failure_mode == "skip" else "aborted"
            stopped = F.coalesce(stopped, F.when(n > 0, after))
    return counts.select(F.inline(F.array(*lines)))


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """The report of all checks; raises when an ``abort`` check has failed."""
    report = check_report(df, checks)
    lines = report.collect()  # one row per check
    failed = [r["check"] for r in lines if r["failure_mode"] == "abort" and r["outcome"] == "failed"]
    if failed:
        raise DataQualityError(f"checks failed: {failed}")
    return df.sparkSession.createDataFrame(lines, report.schema)


def equivalence(left: DataFrame, right: DataFrame) -> DataFrame:
    """Compare two results as bags of rows in one shuffle.

    Columns are matched by name; ``same_schema`` also compares names and types.
    """
    same_columns = sorted(left.columns) == sorted(right.columns)
    same_schema = sorted((f.name, f.dataType.simpleString()) for f in left.schema) == sorted(
        (f.name, f.dataType.simpleString()) for f in right.schema
    )
    names = left.columns
    if not same_columns:
        names = []  # nothing to compare but the counts
    sides = left.select(*[F.col(f"`{c}`") for c in names], F.lit(1).alias("_l"), F.lit(0).alias("_r"))
    other = right.select(*[F.col(f"`{c}`") for c in names], F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    rows = sides.unionByName(other).groupBy(*[f"`{c}`" for c in names]).agg(
        F.sum("_l").alias("_l"), F.sum("_r").alias("_r")
    )
    gap = F.col("_l") - F.col("_r")
    return rows.agg(
        F.coalesce(F.sum("_l"), F.lit(0)).alias("rows_left"),
        F.coalesce(F.sum("_r"), F.lit(0)).alias("rows_right"),
        F.coalesce(F.sum(F.greatest(gap, F.lit(0))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.greatest(-gap, F.lit(0))), F.lit(0)).alias("only_right"),
    ).select(
        "*",
        F.lit(same_schema).alias("same_schema"),
        (F.lit(same_schema) & (F.col("only_left") == 0) & (F.col("only_right") == 0)).alias(
            "equivalent"
        ),
    )


def _fingerprints(rows: DataFrame, names: Sequence[str], buckets: int) -> DataFrame:
    """Per bucket of rows their number and sums of two hashes, whatever their order."""
    first, second = F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in names])
    halves = [
        F.sum(half(h)) for h in (first, second)
        for half in (lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)), lambda x: F.shiftrightunsigned(x, 32))
    ]
    return rows.groupBy(F.pmod(first, F.lit(buckets)).alias("_bucket")).agg(
        F.struct(F.count(F.lit(1)), *halves).alias("_print")
    )


def differences(left: DataFrame, right: DataFrame, samples: int | None = 20, buckets: int = 4096) -> DataFrame:
    """The rows that two results do not share, as bags: ``only_in`` left or right, and ``times``.

    Equal results shuffle one fingerprint a bucket and task. Only rows of buckets whose
    fingerprints differ are compared one by one. ``samples`` bounds the rows returned of each
    side, by the order of the columns; None returns all. Both need the same column names.
    """
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError("the results have different columns")
    names = left.columns
    right = right.select(*[F.col(f"`{c}`") for c in names])
    a, b = (_fingerprints(side, names, buckets) for side in (left, right))
    unlike = (
        a.withColumnRenamed("_print", "_a").join(b.withColumnRenamed("_print", "_b"), "_bucket", "full")
        .filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("_bucket")
    )

    def suspects(side: DataFrame, sign: int) -> DataFrame:
        own = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.lit(buckets))
        # at most as many rows as there are buckets
        return side.withColumn("_own", own).join(F.broadcast(unlike), F.col("_own") == F.col("_bucket"), "left_semi").select(
            *[F.col(f"`{c}`") for c in names], F.lit(sign).alias("_sign")
        )

    gaps = (
        suspects(left, 1).unionByName(suspects(right, -1)).groupBy(*[f"`{c}`" for c in names])
        .agg(F.sum("_sign").alias("_gap")).filter("_gap <> 0")
    )
    found = gaps.select(
        *[F.col(f"`{c}`") for c in names], F.when(F.col("_gap") > 0, "left").otherwise("right").alias("only_in"),
        F.abs("_gap").alias("times"),
    )
    if samples is None:
        return found
    sides = [found.filter(F.col("only_in") == s).orderBy(*[f"`{c}`" for c in names]).limit(samples) for s in ("left", "right")]
    return sides[0].unionByName(sides[1])
