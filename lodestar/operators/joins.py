"""Checked left joins, filter propagation and match cascades."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from enum import IntEnum
from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import quoted
from lodestar.operators.ordered import matches
from lodestar.sources.staging import stage


class RowIntegrity(IntEnum):
    """What a left join does about several target rows for one key."""

    ANY = 0
    CHECKED = 1
    DISTINCT_TARGET = 2


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key in the given order; remaining columns break ties.

    A plain aggregate, so rows of a frequent key are combined before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c in rest]
    lead += [c for c in rest if c not in lead]
    picked = F.min(F.struct(*[F.col(f"`{c}`") for c in lead])) if lead else None
    if picked is None:
        return df.distinct()
    first = df.groupBy(*quoted(keys)).agg(picked.alias("_first"))
    return first.select(
        *[
            F.col(f"`{c}`") if c in keys else F.col("_first").getField(c).alias(c)
            for c in df.columns
        ]
    )


def join_and_expand(
    source: DataFrame,
    target: DataFrame,
    on: Sequence[str],
    expand: Sequence[str],
    *,
    integrity: RowIntegrity = RowIntegrity.ANY,
    target_on: Sequence[str] | None = None,
    expand_as: Sequence[str] | None = None,
    first_by: Sequence[str] = (),
    match_nulls: bool = True,
) -> DataFrame:
    """Left outer join that adds chosen target columns to the source.

    Null keys match null keys; tables bucketed by keys without nulls join in place
    with ``match_nulls`` off. With ``CHECKED`` the job that reads the result fails when
    a source row meets several target rows; ``DISTINCT_TARGET`` keeps the first target
    row per key in ``first_by`` order.
    """
    target_on = list(on if target_on is None else target_on)
    expand_as = list(expand if expand_as is None else expand_as)
    clash = sorted(set(expand_as) & set(source.columns))
    if clash:
        raise ValueError(f"columns already in the source: {clash}")
    if integrity == RowIntegrity.DISTINCT_TARGET:
        wanted = dict.fromkeys([*target_on, *expand, *first_by])
        target = first_rows(target.select(*wanted), target_on, first_by)
    names = [f"_key{i}" for i in range(len(on))]
    keys = [F.col(f"`{c}`").alias(n) for c, n in zip(target_on, names, strict=True)]
    same = matches(on, names, match_nulls)
    if integrity == RowIntegrity.CHECKED:
        # one row per target key goes into the join and brings the number of its rows
        values = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(expand)])
        single = target.groupBy(*keys).agg(F.count(F.lit(1)).alias("_many"), F.min(values).alias("_first"))
        failed = F.raise_error(F.lit("Left join has generated additional rows")).cast("boolean")
        joined = source.join(single, same, "left")
        checked = joined.filter(F.when(F.coalesce("_many", F.lit(1)) == 1, True).otherwise(failed))
        return checked.select(
            *quoted(source.columns),
            *[F.col("_first").getField(f"v{i}").alias(n) for i, n in enumerate(expand_as)],
        )
    columns = target.select(
        *keys, *[F.col(f"`{c}`").alias(n) for c, n in zip(expand, expand_as, strict=True)]
    )
    return source.join(columns, same, "left").drop(*names)


def reduce_bridge(
    bridge: DataFrame, bridge_key: str, keys: DataFrame, key: str
) -> DataFrame:
    """Bridge rows whose key the filtered table holds."""
    held = keys.select(F.col(key).alias("_key")).distinct()
    return bridge.join(held, F.col(f"`{bridge_key}`") == F.col("_key"), "left_semi")


def through_bridge(
    fact: DataFrame, key: str, bridge: DataFrame, bridge_key: str, group: str
) -> DataFrame:
    """Fact rows with the bridge group they belong to, over a many-to-many bridge.

    The bridge is reduced to distinct pairs first, so each fact row comes once per
    group. A null key relates to nothing.
    """
    pairs = bridge.select(F.col(bridge_key).alias("_key"), group).distinct()
    return fact.join(pairs, F.col(f"`{key}`") == F.col("_key")).drop("_key")


def values_in_use(dim: DataFrame, key: str, fact: DataFrame, fact_key: str) -> DataFrame:
    """Dimension rows that have at least one fact row: valid slicer values.

    The keys in use are made distinct first, so a frequent key is one row.
    """
    used = fact.select(F.col(fact_key).alias("_key")).distinct()
    return dim.join(used, F.col(key) == F.col("_key"), "left_semi")


def without_members(
    fact: DataFrame, fact_key: str, dim: DataFrame, key: str, excluded: Column
) -> DataFrame:
    """Fact rows except those of the excluded members; rows without a member stay."""
    gone = dim.filter(excluded).select(F.col(key).alias("_key"))
    return fact.join(gone, F.col(fact_key) == F.col("_key"), "left_anti")


def not_in_model(
    source: DataFrame, model: DataFrame, on: Sequence[str]
) -> DataFrame:
    """Source columns that the model does not use (anti-join on table and column)."""
    names = [f"_key{i}" for i in range(len(on))]
    used = model.select(*quoted(on)).distinct().toDF(*names)
    return source.join(used, matches(on, names), "left_anti")


@dataclass(frozen=True)
class Dimension:
    """A dimension of a star: its rows, its key and the fact column that holds it."""

    rows: DataFrame
    key: str
    fact_key: str


@dataclass(frozen=True)
class Filter:
    """A predicate on one column of a table; the table ``fact`` is the fact itself.

    Without a predicate it is the filter of a group: the column has the group's value.
    """

    table: str
    column: str
    predicate: Column | None = None


@dataclass(frozen=True)
class FilterContext:
    """The filters a measure is taken under; all of them must hold.

    ``selected`` are those of the layer outside, the selection that was there before the
    groups of a report or the filters of a measure were added.
    """

    filters: tuple[Filter, ...] = ()
    selected: tuple[Filter, ...] = ()

    def layer(self, *added: Filter) -> FilterContext:
        """A layer on top of this context, which becomes the selection."""
        return FilterContext((*self.filters, *added), self.filters)

    def grouped(self, *columns: tuple[str, str]) -> FilterContext:
        """A layer with the filters of groups by (table, column) pairs."""
        return self.layer(*[Filter(t, c) for t, c in columns])

    def all_selected(self, table: str | None = None, *columns: str) -> FilterContext:
        """Only the selection's filters: on all tables, one table or some of its columns."""

        def meant(f: Filter) -> bool:
            return table is None or f.table == table and (not columns or f.column in columns)

        inner = tuple(f for f in self.filters if not meant(f))
        return replace(self, filters=(*inner, *[f for f in self.selected if meant(f)]))

    def groups(self) -> set[tuple[str, str]]:
        """The columns that the group's filter is still on."""
        return {(f.table, f.column) for f in self.filters if f.predicate is None}

    def keep(self, *added: Filter) -> FilterContext:
        """Add filters to those already on their columns."""
        return replace(self, filters=(*self.filters, *added))

    def replace(self, *added: Filter) -> FilterContext:
        """Add filters in place of those on the same columns."""
        taken = {(f.table, f.column) for f in added}
        return replace(self, filters=(*[f for f in self.filters if (f.table, f.column) not in taken], *added))

    def clear(self, table: str, *columns: str) -> FilterContext:
        """Drop the filters on some columns of a table, or on all of them."""
        return replace(self, filters=tuple(
            f for f in self.filters if f.table != table or (columns and f.column not in columns)
        ))

    def clear_except(self, *kept: tuple[str, str] | str) -> FilterContext:
        """Drop all filters but those on the given tables or (table, column) pairs."""
        return replace(self, filters=tuple(f for f in self.filters if f.table in kept or (f.table, f.column) in kept))

    def by_table(self) -> dict[str, Column]:
        """One predicate per filtered table."""
        out: dict[str, Column] = {}
        for f in self.filters:
            if f.predicate is None:
                continue
            out[f.table] = out[f.table] & f.predicate if f.table in out else f.predicate
        return out


@dataclass(frozen=True)
class Star:
    """A fact with its dimensions; measures are taken over a filtered fact."""

    fact: DataFrame
    dimensions: Mapping[str, Dimension]

    def filtered(
        self, filters: Mapping[str, Column], clear: Sequence[str] = ()
    ) -> DataFrame:
        """Fact rows under the filters, except those on the cleared tables.

        A filter named ``fact`` applies to the fact itself. Filters intersect.
        """
        rows = self.fact
        for table, predicate in filters.items():
            if table in clear:
                continue
            if table == "fact":
                rows = rows.filter(predicate)
                continue
            dim = self.dimensions[table]
            keys = dim.rows.filter(predicate).select(F.col(dim.key).alias("_key"))
            # a dimension has no null key; plain equality leaves the rows partitioned
            # by the fact key for what follows
            rows = rows.join(keys, F.col(dim.fact_key) == F.col("_key"), "left_semi")
        return rows

    def under(self, context: FilterContext) -> DataFrame:
        """Fact rows under the filters of a context."""
        return self.filtered(context.by_table())

    def sums(
        self, context: FilterContext, by: Mapping[str, tuple[str, str]],
        measures: Mapping[str, tuple[Callable[[FilterContext], FilterContext], Column]],
    ) -> DataFrame:
        """Sums under many contexts by groups, from one pass over the fact.

        ``by`` names (table, column) pairs to group by, ``measures`` how each measure changes
        the context of its group and what it sums. Every dimension is joined once, with one
        bit per predicate that some context has on it. A measure without the filter of a group
        column sums over the groups. Groups without a row in the selection are left out.
        """
        own = context.grouped(*by.values())
        contexts = {name: change(own) for name, (change, _) in measures.items()}
        predicates: dict[str, list[Column]] = {}
        needs: dict[str, dict[str, int]] = {}
        for name, c in {**contexts, "": context}.items():
            needs[name] = {}
            for table, predicate in c.by_table().items():
                listed = predicates.setdefault(table, [])
                listed.append(predicate)
                needs[name][table] = len(listed) - 1
        rows = self.fact
        for table in dict.fromkeys([*predicates, *[t for t, _ in by.values()]]):
            if table == "fact":
                continue
            dim = self.dimensions[table]
            columns = [F.col(f"`{c}`").alias(f"_by_{name}") for name, (t, c) in by.items() if t == table]
            known = dim.rows.select(F.col(dim.key).alias(f"_key_{table}"), _mask(predicates.get(table, [])).alias(f"_mask_{table}"), *columns)
            rows = rows.join(known, F.col(dim.fact_key) == F.col(f"_key_{table}"), "left")
        rows = rows.select(
            "*", _mask(predicates.get("fact", [])).alias("_mask_fact"),
            *[F.col(f"`{c}`").alias(f"_by_{name}") for name, (t, c) in by.items() if t == "fact"],
        )

        def inside(name: str) -> Column:
            met = [F.coalesce(F.getbit(f"_mask_{t}", F.lit(i)) == 1, F.lit(False)) for t, i in needs[name].items()]
            return reduce(Column.__and__, met, F.lit(True))

        parts = rows.groupBy(*[F.col(f"_by_{name}").alias(name) for name in by]).agg(
            F.bool_or(inside("")).alias("_selected"),
            *[F.sum(F.when(inside(name), value)).alias(name) for name, (_, value) in measures.items()],
        )

        def over_groups(name: str) -> Column:
            left = [n for n, pair in by.items() if pair in contexts[name].groups()]
            if len(left) == len(by):
                return F.col(name)
            return F.sum(name).over(Window.partitionBy(*left)).alias(name)

        # one row a group is left, so summing over groups is cheap
        return parts.select(*by, "_selected", *[over_groups(n) for n in measures]).filter("_selected").drop("_selected")

    def related(self, rows: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
        """Fact rows with looked-up columns of a dimension (many to one)."""
        dim = self.dimensions[table]
        return join_and_expand(
            rows, dim.rows, [dim.fact_key], columns, target_on=[dim.key], match_nulls=False
        )


def _mask(predicates: Sequence[Column]) -> Column:
    """A long with a bit for every predicate that holds."""
    if len(predicates) > 63:
        raise ValueError("at most 63 predicates on a table")
    bits = [F.when(p, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, p in enumerate(predicates)]
    return reduce(Column.bitwiseOR, bits, F.lit(0).cast("long"))


def _without_one(texts: Column) -> Column:
    """Every text of an array with one character left out, at every place."""

    def cut(text: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1)))
        return F.transform(places, lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1)))

    return F.array_distinct(F.flatten(F.transform(texts, cut)))


def _deletion_keys(text: Column, limit: int) -> Column:
    """Hashes of the text with up to ``limit`` characters left out.

    Texts within the limit have one of these in common.
    """
    level = F.array(text)
    levels = [level]
    for _ in range(limit):
        level = _without_one(level)
        levels.append(level)
    return F.array_distinct(F.transform(F.concat(*levels), lambda t: F.xxhash64(t)))


def _grams(text: Column, size: int) -> Column:
    """Every run of ``size`` characters with its place."""
    places = F.sequence(F.lit(1), F.greatest(F.char_length(text) - size + 1, F.lit(1)))
    return F.transform(places, lambda i: F.struct(i.alias("place"), F.substr(text, i, F.lit(size)).alias("gram")))


def _rarest_apart(grams: str, size: int, n: int) -> Column:
    """The first n entries of an array in order of rarity that do not overlap."""
    none = F.filter(grams, lambda _: F.lit(False))

    def add(chosen: Column, gram: Column) -> Column:
        apart = F.forall(chosen, lambda c: F.abs(c["place"] - gram["place"]) >= size)
        return F.when(apart & (F.size(chosen) < n), F.concat(chosen, F.array(gram))).otherwise(chosen)

    return F.aggregate(grams, none, add)


def near_candidates(a: DataFrame, b: DataFrame, limit: int, most_keys: int = 2_000) -> DataFrame:
    """Pairs (_a, _b, _key) of texts that hold every pair within ``limit`` edits.

    Texts meet in a deletion key: one text with some characters left out is the other with
    some left out. A key covers a whole text, so what many texts share, as a common prefix,
    makes no pairs. Texts with more than ``most_keys`` keys meet in grams instead: of
    limit + 1 runs apart from each other one is whole in any text within the limit, at most
    ``limit`` places away, and those are taken that the fewest texts of ``b`` have there.
    """
    longest = 0
    while sum(comb(longest + 1, j) for j in range(limit + 1)) <= most_keys:
        longest += 1
    # any place that is picked rules out fewer than two sizes of places around it
    size = (longest - limit + 1 + limit) // (2 * limit + 1)
    if size < 1:
        raise ValueError(f"most_keys is too small for a limit of {limit}")
    n, m = F.char_length("_a"), F.char_length("_b")
    keys = a.filter(n <= longest).select("_a", F.explode(_deletion_keys(F.col("_a"), limit)).alias("_on"))
    held = b.filter(m <= longest).select("_b", "_key", F.explode(_deletion_keys(F.col("_b"), limit)).alias("_on"))
    # the exploded keys are many times their texts, which the planner does not know: a
    # broadcast of them would be built whole on the driver, so both sides are shuffled
    short = keys.join(held.hint("merge"), "_on").select("_a", "_b", "_key")

    every = b.filter(m > longest - limit).select("_b", "_key", F.inline(_grams(F.col("_b"), size)))
    count = every.groupBy("place", "gram").agg(F.count(F.lit(1)).alias("n"))
    rare = (
        every.join(count.hint("merge"), ["place", "gram"]).groupBy("_b", "_key")
        .agg(F.sort_array(F.collect_list(F.struct("n", "place", "gram"))).alias("grams"))
        .select("_b", "_key", F.inline(_rarest_apart("grams", size, limit + 1)))
        .select("_b", "_key", "place", "gram")
    )
    asked = a.filter(n > longest - limit).select("_a", F.inline(_grams(F.col("_a"), size))).select(
        "_a", "gram", F.explode(F.sequence(F.col("place") - limit, F.col("place") + limit)).alias("place")
    )
    long = asked.join(rare.hint("merge"), ["place", "gram"]).select("_a", "_b", "_key")
    return short.unionByName(long).filter(F.abs(n - m) <= limit)


def closest_texts(
    left: DataFrame, text: str, right: DataFrame, other: str, key: str, limit: int = 1
) -> DataFrame:
    """For each left text the right text within ``limit`` edits: closest, then least key.

    Distinct texts only; an equal text ends the search, the others are compared with the
    ``near_candidates``.
    """
    b = right.filter(F.col(other).isNotNull()).groupBy(F.col(other).alias("_b")).agg(
        F.min(key).alias("_key")
    )
    asked = left.select(F.col(text).alias("_a")).filter("_a is not null").distinct()
    # stored, as what follows takes it twice
    met = stage(asked.join(b, F.col("_a") == F.col("_b"), "left"))
    near = (
        near_candidates(met.filter("_b is null").select("_a"), b, limit)
        .select("_a", "_key", F.levenshtein("_a", "_b", limit).alias("_distance"))
        .filter(F.col("_distance") >= 0)
        .groupBy("_a").agg(F.min(F.struct("_distance", "_key")).alias("_best"))
        .select("_a", "_best.*")
    )
    same = met.filter("_b is not null").select("_a", F.lit(0).alias("_distance"), "_key")
    return same.unionByName(near).select(
        F.col("_a").alias(text), F.col("_distance").alias("distance"), F.col("_key").alias(key)
    )


def cascade_match(
    left: DataFrame,
    right: DataFrame,
    exact: Sequence[tuple[str, str]],
    fuzzy: tuple[str, str],
    key: str,
    limit: int = 1,
) -> DataFrame:
    """Find the same entity in two tables: exact columns first, then a close text.

    Adds ``key`` of the matched right row, ``rule`` (``exact``, ``fuzzy``, null when
    nothing matched) and ``distance``. Of several matches the least key is taken. A
    missing value matches nothing.
    """
    on = [a for a, _ in exact]
    names = [f"_on{i}" for i in range(len(exact))]
    first = (
        right.dropna(subset=[b for _, b in exact])
        .groupBy(*[F.col(f"`{b}`").alias(n) for n, (_, b) in zip(names, exact, strict=True)])
        .agg(F.min(key).alias("_exact"))
    )
    whole = reduce(Column.__and__, [F.col(f"`{a}`").isNotNull() for a in on])
    none = F.lit(None).cast(right.schema[key].dataType)
    # rows that miss a key need no join to be open
    tried = (
        left.filter(whole).join(first, matches(on, names, match_nulls=False), "left")
        .select(*quoted(left.columns), "_exact")
        .unionByName(left.filter(~whole).withColumn("_exact", none))
    )
    text, other = fuzzy
    open_rows = tried.filter("_exact is null").drop("_exact")
    close = closest_texts(open_rows, text, right, other, key, limit).select(
        F.col(text).alias("_text"), F.col(key).alias("_found"), F.col("distance").alias("_distance")
    )
    named = open_rows.filter(F.col(text).isNotNull()).join(close, F.col(text) == F.col("_text"), "left")

    def outcome(rows: DataFrame, found: Column, rule: Column, distance: Column) -> DataFrame:
        return rows.select(*quoted(left.columns), found.alias(key), rule.alias("rule"), distance.alias("distance"))

    fuzzy_rule = F.when(F.col("_found").isNotNull(), "fuzzy")
    return (
        outcome(tried.filter("_exact is not null"), F.col("_exact"), F.lit("exact"), F.lit(0))
        .unionByName(outcome(named, F.col("_found"), fuzzy_rule, F.col("_distance")))
        .unionByName(outcome(open_rows.filter(F.col(text).isNull()), none, F.lit(None).cast("string"), F.lit(None).cast("int")))
    )
