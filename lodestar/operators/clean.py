"""Cleaning: default values, restored types and readable column names."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.text import LIKE_NULL_TEXTS, split_camel_case_name
from lodestar.operators.keys import SKEY_PREFIX
from lodestar.sources.tables import try_types

# Fixed values that replace missing ones.
UNKNOWN_TEXT = "Unknown"
UNKNOWN_SKEY = -1
UNKNOWN_NUMBER = 0


def replace_with_default(
    df: DataFrame, columns: Sequence[str], replace_numbers: bool = False
) -> DataFrame:
    """Put default values in place of missing ones, in the listed columns only.

    Surrogate keys get -1, text that is null or stands for null gets ``Unknown``,
    and other numbers get 0 when ``replace_numbers`` is set.
    """

    def filled(name: str) -> Column:
        c = F.col(f"`{name}`")
        kind = df.schema[name].dataType
        if name not in columns:
            return c
        if isinstance(kind, T.StringType):
            missing = c.isNull() | F.lower(c).isin(*LIKE_NULL_TEXTS)
            return F.when(missing, UNKNOWN_TEXT).otherwise(c).alias(name)
        if isinstance(kind, T.NumericType):
            if name.startswith(SKEY_PREFIX):
                return F.coalesce(c, F.lit(UNKNOWN_SKEY).cast(kind)).alias(name)
            if replace_numbers:
                return F.coalesce(c, F.lit(UNKNOWN_NUMBER).cast(kind)).alias(name)
        return c

    return df.select(*[filled(c) for c in df.columns])


def set_types_from_model(df: DataFrame, model: DataFrame, strict: bool = False) -> DataFrame:
    """Give columns the types they have in the model table, by name.

    A model column the table lacks is an error; other columns stay as they are.
    """
    return try_types(df, model.schema, strict)


def union_restore_types(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Append tables whose types differ; the types of the first one are kept.

    A column that a table lacks is null in its rows.
    """
    out = first
    for other in others:
        shared = T.StructType([f for f in first.schema if f.name in other.columns])
        out = out.unionByName(try_types(other, shared), allowMissingColumns=True)
    return out


def split_camel_case_columns(
    df: DataFrame, overrides: Mapping[str, str] | None = None
) -> DataFrame:
    """Rename all columns to separate words; given new names win."""
    overrides = dict(overrides or {})
    unknown = sorted(set(overrides) - set(df.columns))
    if unknown:
        raise ValueError(f"columns not found: {unknown}")
    names = [overrides.get(c, split_camel_case_name(c)) for c in df.columns]
    twice = sorted(n for n, many in Counter(names).items() if many > 1)
    if twice:
        raise ValueError(f"several columns would be called {twice}")
    return df.toDF(*names)
