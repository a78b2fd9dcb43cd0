import datetime as dt
import random
from decimal import Decimal

import pytest
from compare import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.operators import ordered
from lodestar.operators.keys import (
    add_surrogate_key,
    build_dimension,
    extend_registry,
    lookup_snapshot_key,
)
from lodestar.operators.ordered import add_index, cumulative_to_incremental, group_rows
from lodestar.sources.staging import _staged


def test_cumulative_to_incremental(spark):
    df = spark.createDataFrame(
        [
            (dt.date(2024, 1, 1), "a", 10), (dt.date(2024, 1, 3), "a", 25),
            (dt.date(2024, 1, 2), "a", 15), (dt.date(2024, 1, 1), None, 7),
            (dt.date(2024, 1, 2), None, None), (dt.date(2024, 1, 3), None, 9),
        ],
        "day date, g string, `Running Total` int",
    )
    got = cumulative_to_incremental(df, ["g"], "day", ["Running Total"])
    assert got.columns == ["g", "day", "Running Total", "Running Total Incremental"]
    assert got.schema["Running Total Incremental"].dataType.simpleString() == "int"
    changes = {(r["g"], r["day"].day): r["Running Total Incremental"] for r in got.collect()}
    assert changes == {
        ("a", 1): 10, ("a", 2): 5, ("a", 3): 10, (None, 1): 7, (None, 2): None, (None, 3): None,
    }


@settings(max_examples=6, deadline=None)
@given(
    st.lists(
        st.tuples(st.sampled_from(["hot", "hot", "a", "b", None]), st.integers(0, 9) | st.none()),
        min_size=1, max_size=60,
    ),
    st.sampled_from([1, 2, 8]),
    st.booleans(),
)
def test_changes_on_any_cluster(spark, data, partitions, adaptive):
    df = spark.createDataFrame(
        [(i, g, v) for i, (g, v) in enumerate(data)], "i int, `g.g` string, v int"
    )
    before = {}
    expected = []
    for i, (g, v) in enumerate(data):
        last = before.get(g, 0) if g in before else 0
        expected.append((g, i, v, None if v is None or last is None else v - last))
        before[g] = v
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = rows(cumulative_to_incremental(df, ["g.g"], "i", ["v"]))
        chunks = group_rows(df, ["g.g"], ["i"], chunk_rows=3).orderBy("`g.g`", "chunk").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted(got, key=lambda r: r[1]) == expected
    for g in {g for g, _ in data}:
        mine = [r for r in chunks if r["g.g"] == g]
        ids = [i for i, (h, _) in enumerate(data) if h == g]
        assert [r["chunk"] for r in mine] == list(range(len(mine)))
        assert [[x["i"] for x in r["Group"]] for r in mine] == [ids[k : k + 3] for k in range(0, len(ids), 3)]


def test_heavy_group_spreads_over_partitions(spark):
    hot = spark.range(0, 20000, 1, 4).select(F.lit("hot").alias("g"), "id", F.lit(1).alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = ordered.number_partitions(hot, ["g", "id"]).groupBy("_part").count().collect()
        got = cumulative_to_incremental(hot, ["g"], "id", ["v"])
        assert got.agg(F.sum("v Incremental")).first()[0] == 1  # increments add up to the last reading
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 10000


def test_index_is_dense_and_ordered(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"))
    got = add_index(df, "n", ["k"])
    assert got.filter("n <> k").count() == 0 and got.count() == 5000
    assert add_index(df, "n", [F.desc("k")], start=1).filter("n <> 5000 - k").count() == 0


def test_index_of_equal_rows(spark):
    copies = spark.range(3000).select(F.lit("copy").alias("t"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = ordered.number_partitions(copies, ["t"]).groupBy("_part").count().collect()
        got = add_index(copies, "n", ["t"])
        assert sorted(r["n"] for r in got.collect()) == list(range(3000))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) == 4


def test_ranges_follow_the_order_of_any_type(spark):
    rng = random.Random(2)
    moment = dt.datetime(2024, 11, 3, 5)  # the hour that comes twice in New York
    data = [
        (
            rng.choice([None, float("nan"), -0.5, 1e300, float("-inf")]), rng.choice([None, "", "it's", "a\\b", "é", "日"]),
            moment + dt.timedelta(seconds=rng.randrange(7200)), rng.choice([None, True, False]), bytes([rng.randrange(256)]),
            Decimal(rng.randrange(-999, 999)) / 100, i,
        )
        for i in range(2000)
    ]
    schema = "f double, `s``x` string, ts timestamp, b boolean, raw binary, d decimal(10,2), i int"
    df = spark.createDataFrame(data, schema).repartition(6)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in (zone, "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            for order in (["ts", "i"], ["f", "s`x", "i"], ["raw", "d", "i"], ["b", "ts", "i"]):
                cuts = ordered.range_cuts(df, order)
                assert len(cuts) == 15
                cols = ["`" + c.replace("`", "``") + "`" for c in order]
                placed = df.select(*cols, ordered.range_number(df, order, cuts).alias("part")).orderBy(*cols).collect()
                parts = [r["part"] for r in placed]
                assert parts == sorted(parts) and set(parts) == set(range(16))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_heavy_values_and_odd_types_have_no_cuts(spark):
    df = spark.range(4000).select((F.col("id") % 3).alias("few"), F.array("id").alias("list"), "id")
    assert ordered.range_cuts(df, ["few"]) is None and ordered.range_cuts(df, ["list"]) is None
    assert ordered.range_cuts(df.limit(0), ["id"]) == []
    assert len(ordered.range_cuts(df, ["few", "id"])) == 15


def test_wide_rows_are_not_stored(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), "id", (F.col("id") * 2).alias("v"))
    before = len(_staged)
    got = cumulative_to_incremental(df, ["g"], "id", ["v"]).filter("`v Incremental` <> if(id < 2, id * 2, 4)")
    assert got.count() == 0 and add_index(df, "n", ["id"]).filter("n <> id").count() == 0
    assert len(_staged) == before


def test_group_rows(spark):
    df = spark.range(50).select(
        F.when(F.col("id") < 40, "hot").otherwise(F.col("id").cast("string")).alias("g"),
        (50 - F.col("id")).alias("o"), "id",
    )
    whole = {r["g"]: [x["id"] for x in r["Group"]] for r in group_rows(df, ["g"], ["o"]).collect()}
    assert whole["hot"] == list(range(39, -1, -1)) and len(whole) == 11
    pieces = group_rows(df, ["g"], ["o"], chunk_rows=6).orderBy("g", "chunk").collect()
    joined = {}
    for r in pieces:
        assert len(r["Group"]) <= 6
        joined.setdefault(r["g"], []).extend(x["id"] for x in r["Group"])
    assert joined == whole


def test_surrogate_keys(spark):
    df = spark.createDataFrame(
        [("b", 1, "x"), ("a", 1, "y"), (None, 2, "z"), ("b", 1, "w"), (None, 2, "v")],
        "p string, q int, r string",
    )
    keyed = add_surrogate_key(df, "Thing", ["p", "q"])
    assert keyed.columns == ["p", "q", "r", "_SKey Thing"]
    got = {r["r"]: r["_SKey Thing"] for r in keyed.collect()}
    assert got == {"z": 0, "v": 0, "y": 1, "x": 2, "w": 2}
    with pytest.raises(ValueError, match="order"):
        add_surrogate_key(df, "Row")
    by_row = add_surrogate_key(df, "Row", order=["r"])
    assert sorted(r["_SKey Row"] for r in by_row.collect()) == [0, 1, 2, 3, 4]


def test_dimension_key_must_be_unique(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, "b", 5)], "k int, a string, b int")
    assert rows(build_dimension(df, "k", ["a", "b"])) == [(1, "a", None), (2, "b", 5)]
    bad = df.unionByName(spark.createDataFrame([(2, "c", 5)], df.schema))
    with pytest.raises(Exception, match="key k is not unique: 2"):
        build_dimension(bad, "k", ["a", "b"]).collect()
    assert build_dimension(bad, "k", ["a", "b"], check=False).count() == 3


def test_snapshot_lookup(spark):
    staff = spark.createDataFrame(
        [(1, "red", "2024-01-01"), (1, "blue", "2024-02-01"), (2, "red", "2024-01-01")],
        "employee int, colour string, snapshot string",
    )
    dim = add_surrogate_key(staff, "Employee", ["employee", "snapshot"])
    fact = spark.createDataFrame([(9, 1, "2024-02-01"), (8, 2, "2024-02-01")], "id int, employee int, snapshot string")
    got = lookup_snapshot_key(fact, dim, ["employee", "snapshot"], "Employee")
    assert {r["id"]: r["_SKey Employee"] for r in got.collect()} == {9: 1, 8: None}


def test_registered_keys_stay(spark):
    def load(*kinds):
        return spark.createDataFrame([(k, i) for i, k in enumerate(kinds)], "kind string, i int")

    first = extend_registry(None, load("b", "d", "d", None), "Kind", ["kind"])
    assert rows(first) == [("b", 1), ("d", 2), (None, 0)]
    second = extend_registry(first, load("a", "b", None, "c", "a"), "Kind", ["kind"])
    assert rows(second) == [("a", 3), ("b", 1), ("c", 4), ("d", 2), (None, 0)]
    assert rows(extend_registry(second, load("a"), "Kind", ["kind"])) == rows(second)
    assert rows(extend_registry(first.limit(0), load("x"), "Kind", ["kind"])) == [("x", 0)]
