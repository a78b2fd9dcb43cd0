import pytest
from compare import rows

from lodestar.operators.clean import (
    replace_with_default,
    set_types_from_model,
    split_camel_case_columns,
    union_restore_types,
)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        [("A", 1.0, 5, "q"), (None, None, None, None), ("bLank", 2.0, 6, "null"), ("", 0.0, 7, "x")],
        "TextCol string, NumberCol double, `_SKey X` long, Other string",
    )


def test_texts_and_keys(table):
    got = replace_with_default(table, ["TextCol", "NumberCol", "_SKey X"])
    assert got.schema == table.schema or got.columns == table.columns
    assert rows(got) == [
        ("A", 1.0, 5, "q"), ("Unknown", 0.0, 7, "x"), ("Unknown", 2.0, 6, "null"),
        ("Unknown", None, -1, None),
    ]


def test_numbers_only_on_request(table):
    got = replace_with_default(table, ["NumberCol"], replace_numbers=True)
    assert got.filter("NumberCol = 0").count() == 2
    assert got.filter("TextCol IS NULL").count() == 1
    assert got.filter("`_SKey X` IS NULL").count() == 1


def test_types_from_model(spark):
    model = spark.createDataFrame([], "n int, d date, s string")
    text = spark.createDataFrame([("1", "2024-01-02", "a", 9), ("x", "no", "b", 8)], "n string, d string, s string, extra int")
    got = set_types_from_model(text, model)
    assert [f.dataType.simpleString() for f in got.schema] == ["int", "date", "string", "int"]
    assert [str(r["n"]) for r in got.orderBy("extra").collect()] == ["None", "1"]
    with pytest.raises(ValueError, match="not found"):
        set_types_from_model(text.drop("d"), model)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        set_types_from_model(text, model, strict=True).collect()


def test_union_keeps_the_first_types(spark):
    first = spark.createDataFrame([(1, 2.5)], "a int, b double")
    second = spark.createDataFrame([("2", "x"), ("3", "4")], "a string, c string")
    got = union_restore_types(first, second)
    assert got.dtypes == [("a", "int"), ("b", "double"), ("c", "string")]
    assert rows(got.select("a", "b")) == [(1, 2.5), (2, None), (3, None)]


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "customerName int, HTMLPage int, `_SKey X` int")
    got = split_camel_case_columns(df, {"_SKey X": "Key"})
    assert got.columns == ["Customer Name", "HTML Page", "Key"]
    with pytest.raises(ValueError, match="not found"):
        split_camel_case_columns(df, {"nope": "x"})


def test_two_columns_must_not_get_one_name(spark):
    with pytest.raises(ValueError, match="several columns"):
        split_camel_case_columns(spark.createDataFrame([(1, 2)], ["aB", "a B"]))
