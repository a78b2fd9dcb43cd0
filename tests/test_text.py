import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions.dates import age_bucket, end_of_month, fiscal_year, quarter_name
from lodestar.functions.measures import blank_minus, distinct_count, divide, selected_value
from lodestar.functions.text import (
    bracket_references,
    contains_any,
    first_capture,
    is_like_null,
    split_camel_case,
    split_camel_case_name,
)

CAMEL = [
    ("helloWorld", "Hello World"),
    ("ThisIsAnExampleString", "This Is An Example String"),
    ("HTMLParser", "HTML Parser"),
    ("Column1", "Column 1"),
    ("l_orderkey", "L _orderkey"),
    ("AB C", "ABC"),
    ("Q1 sales", "Q1sales"),
    ("ab  cd", "Ab cd"),
    ("élanVital", "Élan Vital"),
    ("", ""),
]


def values(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn("t")).collect()]


def test_split_camel_case(spark):
    assert values(spark, [t for t, _ in CAMEL], split_camel_case) == [w for _, w in CAMEL]
    assert [split_camel_case_name(t) for t, _ in CAMEL] == [w for _, w in CAMEL]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("abAB1_ éÉ", max_size=12), min_size=200, max_size=200))
def test_both_forms_of_the_rule_agree(spark, texts):
    assert values(spark, texts, split_camel_case) == [split_camel_case_name(t) for t in texts]


def test_like_null(spark):
    texts = ["Hello", None, "Justin", "BLanK", "", "unknown", "NULL", "empty", "(blank)"]
    assert values(spark, texts, is_like_null) == [
        False, True, False, True, True, True, True, True, False,
    ]
    numbers = spark.createDataFrame([(1,), (None,)], "n int").select(is_like_null("n"))
    assert sorted(r[0] for r in numbers.collect()) == [False, True]


def test_patterns(spark):
    assert values(spark, ["xAby", None, "q"], lambda c: contains_any(c, ["aB", "zz"])) == [
        True, False, False,
    ]
    texts = ["a(1) b(2)", "b(2)", "c", None]
    got = values(spark, texts, lambda c: first_capture(c, [r"a\((\d)\)", r"b\((\d)\)"]))
    assert got == ["1", "2", None, None]
    assert values(spark, ["[a] + T[b c]", "none"], bracket_references) == [["a", "b c"], []]


@pytest.mark.parametrize(
    "moment, text",
    [
        (dt.datetime(2024, 5, 9, 13), "today"),
        (dt.datetime(2024, 5, 9, 12), "yesterday"),
        (dt.datetime(2024, 5, 1, 11), "9 days ago"),
        (dt.datetime(2024, 5, 10, 20), "today"),
    ],
)
def test_age_bucket(spark, moment, text):
    df = spark.createDataFrame([(moment,)], "m timestamp_ntz")
    now = F.lit(dt.datetime(2024, 5, 10, 12)).cast("timestamp_ntz")
    assert df.select(age_bucket("m", now)).first()[0] == text


def test_dates(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 31),), (dt.date(2024, 6, 30),)], "d date")
    got = df.orderBy("d").select(
        end_of_month("d", -1), fiscal_year("d"), fiscal_year("d", 1), quarter_name("d")
    ).collect()
    assert tuple(got[0]) == (dt.date(2024, 2, 29), 2024, 2024, "Q1")
    assert got[1][0] == dt.date(2024, 5, 31)
    july = spark.createDataFrame([(dt.date(2024, 7, 1),)], "d date")
    assert july.select(fiscal_year("d")).first()[0] == 2025


def test_blank_rules(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 2), ("c", None)], "g string, v int")
    got = {r["g"]: (r["n"], r["s"]) for r in df.groupBy("g").agg(
        distinct_count("v").alias("n"), selected_value("v", F.lit(-1)).alias("s")
    ).collect()}
    assert got == {"a": (2, -1), "b": (1, 2), "c": (1, None)}
    one = spark.range(1).select(
        divide(F.lit(1.0), F.lit(0.0)), divide(F.lit(1.0), F.lit(None)),
        blank_minus(F.lit(None).cast("int"), F.lit(3)), blank_minus(F.lit(5), F.lit(None).cast("int")),
        blank_minus(F.lit(None).cast("int"), F.lit(None).cast("int")),
    ).first()
    assert tuple(one) == (None, None, -3, 5, None)
