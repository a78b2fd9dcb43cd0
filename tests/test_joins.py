import itertools
import random

import pytest
from compare import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.operators.joins import (
    Dimension,
    Filter,
    FilterContext,
    RowIntegrity,
    Star,
    cascade_match,
    closest_texts,
    join_and_expand,
    near_candidates,
    not_in_model,
    reduce_bridge,
    through_bridge,
    values_in_use,
    without_members,
)


@pytest.fixture(scope="module")
def source(spark):
    return spark.createDataFrame([(1, "x"), (2, "y"), (None, "z"), (5, "w")], "k int, v string")


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame(
        [(1, "one", 2), (1, "uno", 1), (None, "null", 1), (7, "seven", 1), (7, "sept", 2)],
        "k int, name string, place int",
    )


def test_left_join_matches_null_to_null(source, target):
    got = join_and_expand(source, target, ["k"], ["name"])
    assert got.columns == ["k", "v", "name"]
    assert rows(got) == [
        (1, "x", "one"), (1, "x", "uno"), (2, "y", None), (5, "w", None), (None, "z", "null"),
    ]


def test_checked_join_raises_only_for_keys_in_use(source, target):
    checked = join_and_expand(source, target, ["k"], ["name"], integrity=RowIntegrity.CHECKED)
    with pytest.raises(Exception, match="additional rows"):
        checked.collect()
    with pytest.raises(Exception, match="additional rows"):
        checked.select("v").collect()
    other = target.filter("name <> 'uno' OR name IS NULL")  # 7 stays repeated but unused
    got = join_and_expand(source, other, ["k"], ["name"], integrity=RowIntegrity.CHECKED)
    assert got.count() == source.count()


def test_first_target_row_per_key(source, target):
    got = join_and_expand(
        source, target, ["k"], ["name"],
        integrity=RowIntegrity.DISTINCT_TARGET, first_by=["place"],
    )
    assert rows(got) == [(1, "x", "uno"), (2, "y", None), (5, "w", None), (None, "z", "null")]


def test_nulls_need_not_match(spark, source):
    twice = spark.createDataFrame([(None, "a"), (None, "b"), (2, "c")], "k int, name string")
    got = join_and_expand(
        source, twice, ["k"], ["name"], integrity=RowIntegrity.CHECKED, match_nulls=False
    )
    assert rows(got) == [(1, "x", None), (2, "y", "c"), (5, "w", None), (None, "z", None)]
    with pytest.raises(Exception, match="additional rows"):
        join_and_expand(source, twice, ["k"], ["name"], integrity=RowIntegrity.CHECKED).collect()


def test_renamed_keys_and_columns(source, target):
    other = target.withColumnRenamed("k", "key")
    got = join_and_expand(source, other, ["k"], ["name"], target_on=["key"], expand_as=["label"])
    assert got.columns == ["k", "v", "label"]
    with pytest.raises(ValueError, match="already in the source"):
        join_and_expand(source, other, ["k"], ["name"], target_on=["key"], expand_as=["v"])


def test_column_names_with_spaces(spark):
    a = spark.createDataFrame([(1,)], "`My Key` int")
    b = spark.createDataFrame([(1, 2)], "`My Key` int, `_SKey X` int")
    assert rows(join_and_expand(a, b, ["My Key"], ["_SKey X"])) == [(1, 2)]


def test_bridge(spark):
    fact = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k int, amount int")
    bridge = spark.createDataFrame(
        [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (4, "b")], "key int, grp string"
    )
    got = through_bridge(fact, "k", bridge, "key", "grp")
    assert rows(got.select("k", "amount", "grp")) == [(1, 10, "a"), (1, 10, "b"), (2, 20, "a")]
    assert reduce_bridge(bridge, "key", fact.filter("k = 2"), "k").count() == 1


def test_values_and_columns_in_use(spark, source, target):
    assert [r["v"] for r in values_in_use(source, "k", target, "k").orderBy("v").collect()] == ["x"]
    assert rows(not_in_model(source, target, ["k"])) == [(2, "y"), (5, "w")]


def test_excluded_members_leave_rows_without_one(source, target):
    kept = without_members(source, "k", target, "k", F.col("place") == 1)
    assert rows(kept) == [(2, "y"), (5, "w"), (None, "z")]


def test_star_filters_and_clearing(spark):
    fact = spark.createDataFrame([(1, 1, 5), (2, 1, 6), (1, 2, 7)], "c int, p int, amount int")
    customers = spark.createDataFrame([(1, "A"), (2, None)], "id int, seg string")
    parts = spark.createDataFrame([(1, "red"), (2, "blue")], "id int, colour string")
    star = Star(fact, {"c": Dimension(customers, "id", "c"), "p": Dimension(parts, "id", "p")})
    filters = {"c": F.col("seg") == "A", "p": F.col("colour") == "red", "fact": F.col("amount") > 0}
    assert rows(star.filtered(filters)) == [(1, 1, 5)]
    assert rows(star.filtered(filters, clear=["p"])) == [(1, 1, 5), (1, 2, 7)]
    assert star.filtered(filters, clear=["p", "c"]).count() == 3
    assert rows(star.related(fact, "p", ["colour"]).select("amount", "colour"))[0] == (5, "red")


def edits(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        line = list(itertools.accumulate(
            range(1, len(b) + 1),
            lambda left, j: min(left + 1, line[j] + 1, line[j - 1] + (x != b[j - 1])),
            initial=i,
        ))
    return line[-1]


@settings(max_examples=4, deadline=None)
@given(
    st.lists(st.text("abc", max_size=5), min_size=1, max_size=12, unique=True),
    st.lists(st.text("abc", max_size=5), min_size=1, max_size=12, unique=True),
    st.sampled_from([1, 2]),
)
def test_closest_texts_is_exact(spark, left, right, limit):
    a = spark.createDataFrame([(t,) for t in left], "t string")
    b = spark.createDataFrame([(i, t) for i, t in enumerate(right)], "key int, o string")
    got = {r["t"]: (r["distance"], r["key"]) for r in closest_texts(a, "t", b, "o", "key", limit).collect()}
    expected = {}
    for t in left:
        best = min((edits(t, o), i) for i, o in enumerate(right))
        if best[0] <= limit:
            expected[t] = best
    assert got == expected


def test_texts_with_a_common_beginning_make_few_candidates(spark):
    a = spark.range(3000).select(F.format_string("Customer#%09d", "id").alias("_a"))
    b = spark.range(3000).select(F.format_string("Custmer#%09d", "id").alias("_b"), F.col("id").alias("_key"))
    assert near_candidates(a, b, 1).count() < 10 * 3000
    itself = spark.range(3000).select(F.format_string("Customer#%09d", "id").alias("t"), F.col("id").alias("key"))
    got = closest_texts(itself, "t", itself.withColumnRenamed("t", "o"), "o", "key")
    assert got.filter("distance = 0").count() == 3000


def _broadcasts_of_exploded_rows(df) -> list[str]:
    """Broadcast exchanges of the physical plan with a Generate below them."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    found = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            below = itertools.takewhile(lambda x: len(x) - len(x.lstrip(" :+-")) > depth, lines[i + 1:])
            if any("Generate" in x for x in below):
                found.append(line.strip())
    return found


@pytest.mark.parametrize("limit,size", [(2, 18), (1, 80)])
def test_exploded_keys_are_not_broadcast(spark, limit, size):
    # a few rows explode into many keys or grams, which the driver would have to hold whole
    a = spark.range(50).select(F.format_string(f"%0{size}d", "id").alias("_a"))
    b = spark.range(50).select(F.format_string(f"%0{size - 1}d", "id").alias("_b"), F.col("id").alias("_key"))
    found = near_candidates(a, b, limit)
    assert _broadcasts_of_exploded_rows(found) == []
    assert found.filter("_a = concat('0', _b)").select("_a", "_b").distinct().count() == 50


@pytest.mark.parametrize("limit,most_keys", [(1, 30), (2, 300), (3, 1000)])
def test_grams_of_long_texts_miss_no_pair(spark, limit, most_keys):
    rng = random.Random(limit)
    texts = ["common words of all " + "".join(rng.choice("ab cd") for _ in range(rng.randint(0, 30))) for _ in range(30)]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(20)]
    for t in list(texts):
        for _ in range(rng.randint(0, limit)):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(["", "x"]) + t[at + rng.choice([0, 1]):]
        texts.append(t)
    a = spark.createDataFrame([(t,) for t in set(texts)], "_a string")
    b = spark.createDataFrame([(t, i) for i, t in enumerate(sorted(set(texts)))], "_b string, _key int")
    found = {(r["_a"], r["_b"]) for r in near_candidates(a, b, limit, most_keys).collect()}
    assert {(x, y) for x in texts for y in texts if edits(x, y) <= limit} <= found


def test_too_few_keys_for_the_limit(spark):
    a = spark.createDataFrame([("x",)], "_a string")
    with pytest.raises(ValueError, match="too small"):
        near_candidates(a, a.select(F.col("_a").alias("_b"), F.lit(1).alias("_key")), 2, 1)


def test_cascade(spark):
    left = spark.createDataFrame(
        [(1, "A", "1", "Anna"), (2, "B", "2", "Berta"), (3, "C", None, "Carl"), (4, "D", "4", "Dora")],
        "id int, a string, b string, c string",
    )
    right = spark.createDataFrame(
        [(10, "A", "1", "x"), (9, "A", "1", "y"), (11, "B", "0", "Bertha"), (12, "C", None, "zz")],
        "ref int, ra string, rb string, rc string",
    )
    got = cascade_match(left, right, [("a", "ra"), ("b", "rb")], ("c", "rc"), "ref")
    assert rows(got.select("id", "ref", "rule", "distance")) == [
        (1, 9, "exact", 0), (2, 11, "fuzzy", 1), (3, None, None, None), (4, None, None, None),
    ]


def test_cascade_spreads_exact_matches(spark):
    left = spark.range(0, 40000, 1, 8).select("id", (F.col("id") % 997).alias("k"), F.lit("same").alias("name"))
    right = spark.range(980).select(F.col("id").alias("ref"), F.col("id").alias("rk"), F.lit("other").alias("rn"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = cascade_match(left, right, [("k", "rk")], ("name", "rn"), "ref")
        parts = got.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exact = sorted(r["count"] for r in parts)
    assert sum(exact) == 40000 and exact[-1] < 2 * 40000 / 4


def test_filter_contexts(spark):
    context = FilterContext((
        Filter("c", "seg", F.lit(True)), Filter("c", "age", F.lit(True)), Filter("fact", "amount", F.lit(True)),
    ))

    def names(c):
        return [(f.table, f.column) for f in c.filters]

    assert names(context.clear("c")) == [("fact", "amount")]
    assert names(context.clear("c", "seg")) == [("c", "age"), ("fact", "amount")]
    assert names(context.clear_except("fact")) == [("fact", "amount")]
    assert names(context.clear_except(("c", "age"))) == [("c", "age")]
    assert names(context.replace(Filter("c", "seg", F.lit(False)))) == [("c", "age"), ("fact", "amount"), ("c", "seg")]
    assert names(context.keep(Filter("c", "seg", F.lit(False)))).count(("c", "seg")) == 2
    assert set(context.by_table()) == {"c", "fact"}


def test_layers_of_filters(spark):
    outer = FilterContext((Filter("c", "seg", F.lit(True)), Filter("fact", "day", F.lit(True))))
    own = outer.grouped(("c", "seg"), ("c", "city"))

    def names(c):
        return [(f.table, f.column, f.predicate is None) for f in c.filters]

    assert own.groups() == {("c", "seg"), ("c", "city")}
    assert names(own.all_selected("c", "seg")) == [("fact", "day", False), ("c", "city", True), ("c", "seg", False)]
    assert names(own.all_selected()) == [("c", "seg", False), ("fact", "day", False)]
    assert own.clear("c").all_selected("c").groups() == set()
    assert names(own.layer(Filter("c", "age", F.lit(True))).all_selected("c", "age")) == names(own)


def test_sums_under_many_contexts(spark):
    rng = random.Random(4)
    facts = [(rng.choice([None, 0, 1, 2, 3, 9]), rng.choice("xy"), rng.randrange(100)) for _ in range(200)]
    dim = [(0, "a", 5), (1, "b", -5), (2, "a", -1), (3, None, 7)]
    star = Star(
        spark.createDataFrame(facts, "k int, day string, v int"),
        {"c": Dimension(spark.createDataFrame(dim, "id int, seg string, age int"), "id", "k")},
    )
    outer = FilterContext((Filter("c", "age", F.col("age") > -2), Filter("fact", "day", F.col("day") == "x")))
    got = star.sums(outer, {"seg": ("c", "seg")}, {
        "own": (lambda c: c, F.col("v")), "selected": (lambda c: c.all_selected("c", "seg"), F.col("v")),
        "other": (lambda c: c.replace(Filter("fact", "day", F.col("day") == "y")), F.col("v")),
        "all": (lambda c: c.clear("c").clear("fact"), F.col("v")),
    })
    known = {i: (s, a) for i, s, a in dim}
    joined = [(*known.get(k, (None, None)), d, v) for k, d, v in facts]

    def total(test):
        return sum((v for s, a, d, v in joined if test(s, a, d)), 0) or None

    expected = [
        (seg, total(lambda s, a, d: s == seg and a is not None and a > -2 and d == "x"),
         total(lambda s, a, d: a is not None and a > -2 and d == "x"),
         total(lambda s, a, d: s == seg and a is not None and a > -2 and d == "y"), total(lambda s, a, d: True))
        for seg in ("a", None)
    ]
    assert rows(got) == expected
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2  # the fact and its dimension once each
