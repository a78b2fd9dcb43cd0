"""Surrogate keys and dimension tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import quoted
from lodestar.operators.joins import join_and_expand
from lodestar.operators.ordered import add_index, matches
from lodestar.operators.quality import require_in_plan

# Fixed value: the prefix of surrogate key columns.
SKEY_PREFIX = "_SKey "


def add_surrogate_key(
    df: DataFrame,
    name: str,
    group_by: Sequence[str] | None = None,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``_SKey <name>``: a key per row, or one per combination of columns.

    Keys are 0, 1, 2, ... in ``order``. With ``group_by`` the combinations are put
    in order themselves; nulls count as a value and get a key.
    """
    column = SKEY_PREFIX + name
    if group_by is None:
        if not order:
            raise ValueError("rows have no order of their own: give order columns")
        return add_index(df, column, order)
    combinations = df.select(*quoted(group_by)).distinct()
    keyed = add_index(combinations, column, list(order or group_by), once=True)
    # each combination occurs once, so the join cannot add rows
    return join_and_expand(df, keyed, group_by, [column])


def extend_registry(
    registry: DataFrame | None, df: DataFrame, name: str, group_by: Sequence[str], order: Sequence[str] | None = None
) -> DataFrame:
    """A registry of keys per combination of columns, with the new combinations of ``df``.

    Known combinations keep their key, new ones get the next keys in ``order``, so keys stay
    dense and never move from load to load. Null counts as a value. Without a registry all
    are new. Store the result before the next load, which then reads it.
    """
    column = SKEY_PREFIX + name
    new = df.select(*quoted(group_by)).distinct()
    if registry is None:
        return add_index(new, column, list(order or group_by), once=True)
    known = [f"_known{i}" for i in range(len(group_by))]
    held = registry.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(group_by, known, strict=True)])
    new = new.join(held, matches(group_by, known), "left_anti")
    # an anti join keeps distinct combinations distinct
    start = registry.agg(F.max(F.col(f"`{column}`"))).first()[0]
    added = add_index(new, column, list(order or group_by), start=0 if start is None else start + 1, once=True)
    return registry.select(*quoted(group_by), F.col(f"`{column}`")).unionByName(added)


def build_dimension(
    df: DataFrame, key: str, attributes: Sequence[str], check: bool = True
) -> DataFrame:
    """Distinct key and attributes; the job fails when the key is not unique.

    The test is part of the plan and reads the distinct rows only, so the source is
    not read a second time.
    """
    dim = df.select(key, *attributes).distinct()
    if not check:
        return dim
    values = F.struct(*[F.col(f"`{c}`") for c in attributes])
    keyed = dim.groupBy(key).agg(F.min(values).alias("_low"), F.max(values).alias("_high"))
    text = F.concat(F.lit(f"key {key} is not unique: "), F.col(f"`{key}`").cast("string"))
    message = F.coalesce(text, F.lit(f"key {key} is not unique: null"))
    checked = require_in_plan(keyed, F.col("_low").eqNullSafe(F.col("_high")), message)
    return checked.select(
        F.col(f"`{key}`"), *[F.col("_low").getField(c).alias(c) for c in attributes]
    )


def lookup_snapshot_key(
    fact: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    name: str,
    dim_on: Sequence[str] | None = None,
) -> DataFrame:
    """Give each fact row the key of its (natural key, snapshot date) version."""
    return join_and_expand(fact, dim, on, [SKEY_PREFIX + name], target_on=dim_on)
