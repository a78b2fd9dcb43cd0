import pytest
from compare import rows
from pyspark.sql import functions as F

from lodestar.operators.keys import add_surrogate_key
from lodestar.operators.quality import (
    Check,
    DataQualityError,
    check_report,
    differences,
    equivalence,
    many_values,
    repeated,
    require,
    require_in_plan,
    require_not_null,
    require_one_to_many,
    require_unique,
    run_checks,
)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(1, 2, "x"), (3, 3, "y"), (5, None, "x")], "a int, b int, c string")


def test_condition(table):
    text = F.concat(F.lit("A: "), F.col("a").cast("string"), F.lit(" cannot equal B: "), F.col("b").cast("string"))
    with pytest.raises(DataQualityError, match="A: 3 cannot equal B: 3"):
        require(table.filter("b is not null"), F.col("a") != F.col("b"), text)
    with pytest.raises(DataQualityError, match="1 rows"):
        require(table.filter("a <> 3"), F.col("a") != F.col("b"), "null is broken")
    assert require(table, F.col("a") > 0, "positive") is table


def test_condition_in_the_plan(table):
    assert require_in_plan(table, F.col("a") > 0, "positive").count() == 3
    with pytest.raises(Exception, match="too large"):
        require_in_plan(table, F.col("a") < 5, "too large").select("c").collect()


def test_unique_and_dependent(table):
    require_unique(table, ["a"])
    with pytest.raises(DataQualityError, match="not unique"):
        require_unique(table, ["c"])
    assert rows(repeated(table, ["c"])) == [("x", 2)]
    assert rows(many_values(table, ["c"], "b")) == [("x", 2)]
    with pytest.raises(DataQualityError, match="determine"):
        require_one_to_many(table, ["c"], "a")
    require_one_to_many(table, ["a"], "c")


def test_nulls(table):
    require_not_null(table, ["a", "c"])
    with pytest.raises(DataQualityError, match="'b', 1"):
        require_not_null(table, ["a", "b"])


def test_suite_modes(table):
    def outcomes(*checks):
        return [r["outcome"] for r in check_report(table, list(checks)).orderBy("position").collect()]

    good, bad = F.col("a") > 0, F.col("a") > 3
    assert outcomes(Check("1", good), Check("2", bad, "continue"), Check("3", good)) == [
        "passed", "warning", "passed",
    ]
    assert outcomes(Check("1", bad, "skip"), Check("2", good)) == ["failed", "skipped"]
    assert outcomes(Check("1", bad), Check("2", bad, "skip"), Check("3", good)) == [
        "failed", "aborted", "aborted",
    ]
    with pytest.raises(DataQualityError, match="'low'"):
        run_checks(table, [Check("low", bad)])
    assert run_checks(table, [Check("low", bad, "continue")]).count() == 1
    with pytest.raises(ValueError, match="failure modes"):
        check_report(table, [Check("x", good, "stop")])


def test_equivalence(spark, table):
    assert equivalence(table, table.orderBy("c")).first()["equivalent"]
    twice = table.unionByName(table)
    got = equivalence(twice, table).first()
    assert tuple(got) == (6, 3, 3, 0, True, False)
    assert not equivalence(table, table.withColumn("a", F.col("a").cast("long"))).first()["same_schema"]
    assert not equivalence(table, table.drop("c")).first()["equivalent"]
    empty = equivalence(table.limit(0), table.limit(0)).first()
    assert tuple(empty) == (0, 0, 0, 0, True, True)


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_differences_name_the_rows(spark, buckets):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c"), (None, "d")], "`k.k` int, v string")
    right = spark.createDataFrame([("a", 1), (None, 2), ("x", 3), ("d", None), ("x", 3)], "v string, `k.k` int")
    assert rows(differences(left, right, buckets=buckets)) == [(1, "a", "left", 1), (3, "c", "left", 1), (3, "x", "right", 2)]
    assert rows(differences(left, right, samples=1, buckets=buckets)) == [(1, "a", "left", 1), (3, "x", "right", 2)]
    assert rows(differences(left, left.repartition(3), buckets=buckets)) == []
    assert rows(differences(left.limit(0), left.limit(0), buckets=buckets)) == []
    zeros = spark.createDataFrame([(0.0,), (float("nan"),)], "x double")
    assert rows(differences(zeros, spark.createDataFrame([(-0.0,), (float("nan"),)], "x double"), buckets=buckets)) == []
    with pytest.raises(ValueError, match="different columns"):
        differences(left, left.drop("v"))


def test_column_names_with_dots(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y")], "`a.b` int, c string")
    assert rows(repeated(df, ["a.b"])) == [(1, 2)]
    assert add_surrogate_key(df, "Thing", ["a.b"]).select("`_SKey Thing`").distinct().count() == 1
