"""Operators that depend on row order, safe for groups of any size.

A table is cut into ranges of its order, so any group may spread over many tasks, and what
goes over an edge, a count or the row before it, is handed on. The cuts come from a sample of
the order columns and stand in the plan as literals: every pass finds the same ranges, the
counts read the order columns only, and the whole rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.text import quoted
from lodestar.sources.staging import stage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row position in these bits


def matches(
    keys: Sequence[str], other_keys: Sequence[str], match_nulls: bool = True
) -> Column:
    """Equality of key columns whose names do not clash, null-safe by default."""
    equal = Column.eqNullSafe if match_nulls else Column.__eq__
    pairs = [
        equal(F.col(f"`{a}`"), F.col(f"`{b}`"))
        for a, b in zip(keys, other_keys, strict=True)
    ]
    return reduce(Column.__and__, pairs)


# A few ranges a task, as ranges are dealt to tasks by hash, and so many sampled rows a range.
_RANGES_PER_TASK = 4
_MOST_RANGES = 1024
_SAMPLED = 20


def _sort_keys(df: DataFrame, order: Sequence[str]) -> tuple[list[str], list[T.DataType]] | None:
    """The order columns as expressions whose values have literals, and their types."""
    plain = T.NumericType | T.DateType | T.TimestampNTZType | T.StringType | T.BooleanType | T.BinaryType
    names, types = [], []
    for c in order:
        name, kind = "`" + c.replace("`", "``") + "`", df.schema[c].dataType
        if isinstance(kind, T.TimestampType):
            # a local time may stand for two moments
            name, kind = f"unix_micros({name})", T.LongType()
        if not isinstance(kind, plain):
            return None
        names.append(name)
        types.append(kind)
    return names, types


def _literal(value: object, kind: T.DataType) -> str:
    """A value as SQL text of its type."""
    if value is None:
        return f"cast(null as {kind.simpleString()})"
    if isinstance(value, str | bytes | bytearray):
        raw = value.encode() if isinstance(value, str) else bytes(value)
        return f"cast(X'{raw.hex()}' as {kind.simpleString()})"
    return f"cast('{value}' as {kind.simpleString()})"


def range_cuts(df: DataFrame, order: Sequence[str]) -> list[Row] | None:
    """Rows of the sort keys at which ranges of about equal size begin, in order.

    None where cuts cannot do it: when one value holds more than a range, when a column has
    no literals, or for more ranges than an expression can hold.
    """
    keys = _sort_keys(df, order)
    ranges = _RANGES_PER_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if ranges > _MOST_RANGES or keys is None:
        return None
    rows = df.select(*[F.expr(k).alias(f"k{i}") for i, k in enumerate(keys[0])])
    drawn = rows.withColumn("_draw", F.xxhash64(F.monotonically_increasing_id()))
    sample = drawn.orderBy("_draw").limit(ranges * _SAMPLED).drop("_draw").orderBy(*rows.columns).collect()
    cuts = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []
    if len(sample) == ranges * _SAMPLED and any(a == b for a, b in zip(cuts, cuts[1:])):
        return None
    return [c for i, c in enumerate(cuts) if i == 0 or c != cuts[i - 1]]


def range_number(df: DataFrame, order: Sequence[str], cuts: Sequence[Row]) -> Column:
    """The range of a row: how many cuts are not after it, found by halving."""
    names, types = _sort_keys(df, order)
    key = f"struct({', '.join(f'{n} as k{i}' for i, n in enumerate(names))})"

    def among(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high + 1) // 2
        cut = ", ".join(f"{_literal(v, t)} as k{i}" for i, (v, t) in enumerate(zip(cuts[middle - 1], types, strict=True)))
        return f"case when {key} >= struct({cut}) then {among(middle, high)} else {among(low, middle - 1)} end"

    return F.expr(among(0, len(cuts)))


def number_partitions(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Sort the table over all tasks; every row gets its partition and position.

    Partitions are in sort order. Rows that tie are spread by a row id, so copies
    of one row cannot pile up in a task. The result is staged because range
    boundaries come from a sample and must not change between two passes.
    """
    keys = [F.col(f"`{o}`") if isinstance(o, str) else o for o in order]
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie")
    at = ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    return stage(at).select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.shiftright("_at", _ROW_BITS).alias("_part"),
        F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_pos"),
    )


def add_index(
    df: DataFrame, name: str, order: Sequence[str | Column], start: int = 0, once: bool = False
) -> DataFrame:
    """Dense index in the given order: start, start + 1, ... without gaps.

    Rows that tie come in any order. The table is read in three passes; with ``once`` it is
    stored instead, which suits a small result that is dear to compute.
    """
    cuts = range_cuts(df, order) if not once and all(isinstance(o, str) for o in order) else None
    if cuts is None:
        rows = number_partitions(df, order)
    else:
        ranged = df.withColumn("_part", range_number(df, order, cuts))
        within = Window.partitionBy("_part").orderBy(*quoted(order))
        rows = ranged.withColumn("_pos", (F.row_number().over(within) - 1).cast("long"))
    # one row per range, so the running offset and the broadcast stay small
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        (rows if cuts is None else ranged).groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return rows.join(F.broadcast(offsets), "_part").select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.col("_offset") + F.col("_pos") + start).alias(name),
    )


def cumulative_to_incremental(
    df: DataFrame,
    group_by: Sequence[str],
    sort_by: str | Sequence[str],
    columns: Sequence[str],
) -> DataFrame:
    """Turn running totals into the change from row to row within each group.

    Adds ``<column> Incremental``; the first row of a group keeps its value. The
    group columns come first. Rows that tie on the sort columns come in the order of the
    given columns.
    """
    order = [sort_by] if isinstance(sort_by, str) else list(sort_by)
    kept = [*group_by, *[c for c in df.columns if c not in group_by]]
    order += [c for c in columns if c not in order and c not in group_by]
    cuts = range_cuts(df, [*group_by, *order])
    if cuts is None:
        rows, at = _with_row_before(number_partitions(df, [*group_by, *order]), group_by, columns), ["_pos"]
    else:
        rows, at = _with_row_of_range_before(df, group_by, order, columns, cuts), ["_pos", *quoted(order)]
    piece = Window.partitionBy("_part", *quoted(group_by)).orderBy(*at)
    first = F.row_number().over(piece) == 1

    def change(c: str) -> Column:
        own = F.col(f"`{c}`")
        value = F.when(first, own).otherwise(own - F.lag(own).over(piece))
        return value.cast(df.schema[c].dataType).alias(f"{c} Incremental")

    changed = rows.select(*quoted(kept), *[change(c) for c in columns], "_pos")
    return changed.filter("_pos >= 0").drop("_pos")


def _with_row_of_range_before(
    df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], cuts: Sequence[Row]
) -> DataFrame:
    """The rows with their range, and the row before each range of a group, at position -1.

    Only the groups that a cut goes through reach into a second range, so the rows of those
    alone are searched for the last one of each range.
    """
    ranged = df.withColumn("_part", range_number(df, [*by, *order], cuts))
    names = [f"_by{i}" for i in range(len(by))]
    keys, kinds = _sort_keys(df, by)
    schema = T.StructType([T.StructField(n, kind) for n, kind in zip(names, kinds, strict=True)])
    groups = list(dict.fromkeys(tuple(c[: len(by)]) for c in cuts))
    cut = df.sparkSession.createDataFrame(groups, schema)
    same = reduce(Column.__and__, [F.expr(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    last = F.max(F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)]))
    ends = (
        ranged.select(*quoted(by), *[F.col(f"`{c}`") for c in order if c not in by], "_part")
        .join(F.broadcast(cut), same, "left_semi")
        .groupBy("_part", *quoted(by)).agg(last.alias("_last"))
    )
    before = F.lag("_last").over(Window.partitionBy(*quoted(by)).orderBy("_part"))
    starts = ends.withColumn("_last", before).filter("_last is not null")
    handed = {c: F.col("_last").getField(f"o{order.index(c)}") for c in columns if c in order}
    return ranged.withColumn("_pos", F.lit(0)).unionByName(
        starts.select(
            "_part", *quoted(by), *[v.alias(c) for c, v in handed.items() if c not in by], F.lit(-1).alias("_pos")
        ),
        allowMissingColumns=True,
    )


def _with_row_before(
    rows: DataFrame, by: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Give each piece of a group the row before it, at position -1.

    ``rows`` come from :func:`number_partitions`. Only one row per partition and
    group is copied; it holds the group and the given columns.
    """
    values = F.struct(*[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(columns)])
    ends = rows.groupBy("_part", *quoted(by)).agg(F.max_by(values, "_pos").alias("_last"))
    before = F.lag("_last").over(Window.partitionBy(*quoted(by)).orderBy("_part"))
    starts = ends.withColumn("_last", before).filter("_last is not null")
    copied = {c: F.col("_last").getField(f"v{i}") for i, c in enumerate(columns)}
    copied["_pos"] = F.lit(-1).cast("long")
    return rows.unionByName(
        starts.select("_part", *quoted(by), *[v.alias(c) for c, v in copied.items()]),
        allowMissingColumns=True,
    )


def group_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    name: str = "Group",
    chunk_rows: int = 100_000,
) -> DataFrame:
    """Nest the rows of each group as arrays of structs in the given order.

    Every group comes in chunks of ``chunk_rows`` rows numbered by ``chunk``, in order;
    only its last chunk may be shorter. A row's chunk follows from its index within its
    group, so the result is the same on any cluster.
    """
    rest = [c for c in df.columns if c not in by]
    rows = number_partitions(df, [*by, *order])
    pieces = rows.groupBy("_part", *quoted(by)).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_start")
    )
    before = Window.partitionBy(*quoted(by)).orderBy("_part")
    names = [f"_by{i}" for i in range(len(by))]
    placed = pieces.select(
        F.col("_part").alias("_piece"), *[F.col(f"`{c}`").alias(n) for c, n in zip(by, names, strict=True)],
        (F.sum("_n").over(before) - F.col("_n") - F.col("_start")).alias("_shift"),
    )
    joined = rows.join(placed, (F.col("_part") == F.col("_piece")) & matches(by, names))
    index = F.col("_pos") + F.col("_shift")
    entries = F.collect_list(F.struct(F.col("_pos").alias("at"), F.struct(*quoted(rest)).alias("row")))
    chunk = F.floor(F.col("_pos") / chunk_rows).alias("chunk")
    keyed = joined.withColumn("_pos", index)
    nested = keyed.groupBy(*quoted(by), chunk).agg(entries.alias("_rows"))
    return nested.select(
        *quoted(by), "chunk", F.transform(F.sort_array("_rows"), lambda e: e["row"]).alias(name)
    )
