import datetime as dt
import os

import pytest
from compare import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.sources.calendars import (
    calendar_window_bridge,
    date_bounds,
    date_dimension,
    days_between,
    days_spanned,
)
from lodestar.sources.staging import stage, staging_root
from lodestar.sources.tables import (
    append_log,
    read_runs,
    write_run,
    expand_json_list,
    inline_table,
    overwrite,
    read_json_list,
    read_typed_csv,
    try_types,
    warehouse_table,
)


def test_typed_csv(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text(
        'Segment,Discount Band,Units Sold,Sales,Date\n'
        'Small "A",None,12.5,300,2014-01-01\nLarge,High,oops,4.25,2014-13-01\n',
        encoding="utf-8",
    )
    types = T.StructType.fromDDL(
        "Segment string, `Discount Band` string, `Units Sold` double, "
        "Sales decimal(19,4), Date date"
    )
    got = read_typed_csv(spark, str(path), types)
    assert got.schema == types
    assert [tuple(map(str, r)) for r in got.orderBy("Segment").collect()] == [
        ("Large", "High", "None", "4.2500", "None"),
        ('Small "A"', "None", "12.5", "300.0000", "2014-01-01"),
    ]
    assert got.filter("`Discount Band` is null").count() == 0
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        read_typed_csv(spark, str(path), types, strict=True).collect()


def test_csv_columns_go_by_name(spark, tmp_path):
    path = tmp_path / "other.csv"
    path.write_text("b,a,extra\nx,1,z\n", encoding="utf-8")
    got = read_typed_csv(spark, str(path), T.StructType.fromDDL("a int, b string"))
    assert [r.asDict() for r in got.collect()] == [{"b": "x", "a": 1, "extra": "z"}]
    with pytest.raises(ValueError, match="not found"):
        read_typed_csv(spark, str(path), T.StructType.fromDDL("c int"))


def test_hello_table(spark):
    df = inline_table(spark, ["id", "name", "score"], [(1, "a", 95), (2, "b", 88), (3, "c", 71)])
    assert [r["id"] for r in df.filter("score > 80").orderBy("id").collect()] == [1, 2]


def test_json_lists(spark, tmp_path):
    path = tmp_path / "issues.json"
    path.write_text('[{"number": 7, "title": "[x] y", "extra": {}},\n {"number": 8, "title": null}]')
    record = T.StructType.fromDDL("number long, title string")
    expected = [(7, "[x] y"), (8, None)]
    assert rows(read_json_list(spark, str(path), record, ["Number", "Title"])) == expected
    text = spark.createDataFrame([(1, path.read_text())], "k int, doc string")
    assert rows(expand_json_list(text, "doc", record)) == [(1, *r) for r in expected]


def test_warehouse_table(spark, tmp_path):
    spark.sql(f"CREATE DATABASE lodestar_test LOCATION '{tmp_path}'")
    try:
        spark.range(3).write.saveAsTable("lodestar_test.three_rows")
        assert warehouse_table(spark, "lodestar_test", "three_rows").count() == 3
        with pytest.raises(Exception, match="cannot be found|NOT_FOUND"):
            warehouse_table(spark, "lodestar_test", "absent").count()
    finally:
        spark.sql("DROP DATABASE lodestar_test CASCADE")


def test_staging_needs_a_shared_folder_on_a_cluster():
    class Cluster:
        conf = {"spark.master": "yarn"}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging_root(Cluster)
    Cluster.conf["spark.checkpoint.dir"] = "hdfs:///shared/"
    assert staging_root(Cluster) == "hdfs:///shared"


def test_staging_falls_back_to_the_warehouse_of_a_local_session():
    class Local:
        conf = {"spark.master": "local[4]", "spark.sql.warehouse.dir": "file:/w/"}

    assert staging_root(Local) == "file:/w/_staging"
    assert staging_root(Local) == staging_root(Local)


def test_empty_tables_have_no_calendar(spark):
    empty = spark.createDataFrame([], "d date")
    assert days_between(spark, *date_bounds(empty, "d")).count() == 0
    assert days_spanned(empty, "d").count() == 0


def test_try_types_needs_the_columns(spark):
    with pytest.raises(ValueError, match="not found"):
        try_types(spark.range(1), T.StructType.fromDDL("x int"))


def test_overwrite_replaces_the_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    overwrite(spark.range(3), path)
    assert overwrite(spark.range(2).withColumn("b", F.lit("x")), path).columns == ["id", "b"]


def test_append_log(spark, tmp_path):
    path = str(tmp_path / "log")
    for day in ("2024-01-01", "2024-01-02"):
        append_log(spark.range(2).withColumn("run_date", F.lit(day).cast("date")), path)
    log = spark.read.parquet(path)
    assert log.count() == 4 and log.filter("run_date = '2024-01-02'").count() == 2


def test_date_dimension(spark):
    days = days_between(spark, dt.date(2013, 1, 1), dt.date(2015, 12, 31))
    dim = date_dimension(days)
    assert dim.columns == ["Date", "Year", "Month", "Month Number", "Quarter"]
    assert dim.count() == 1095
    assert tuple(dim.filter("Date = '2014-11-05'").first())[1:] == (2014, "Nov", 11, "Q4")


def test_calendar_window_bridge(spark):
    days = days_between(spark, dt.date(2023, 6, 1), dt.date(2024, 12, 31))
    bridge = calendar_window_bridge(days, "day").cache()
    assert bridge.count() == 140 * days.count()
    window = bridge.filter("Window = '2024-11-19' AND WindowDaySize = 28 AND WindowDayShift = 0")
    ends = window.agg(F.min("DIM_CalendarKey"), F.max("DIM_CalendarKey"), F.count("*")).first()
    assert tuple(ends) == (dt.date(2024, 10, 23), dt.date(2024, 11, 19), 28)
    year = bridge.filter("Window = '2024-11-19' AND WindowDaySize = 7 AND WindowDayShift = -365")
    assert year.agg(F.max("DIM_CalendarKey")).first()[0] == dt.date(2023, 11, 20)


def test_stage_keeps_rows_and_schema(spark):
    df = spark.range(5).withColumn("X Incremental", F.col("id") * 2)
    got = stage(df)
    assert got.columns == df.columns and rows(got) == rows(df)
    assert staging_root(spark) in got.inputFiles()[0]


def test_a_run_is_there_once_or_not_at_all(spark, tmp_path):
    path, schema = str(tmp_path / "runs"), "id long"
    write_run(spark.range(5), path, "2024-01-01")
    write_run(spark.range(3), path, "20240102")
    write_run(spark.range(7), path, "2024-01-01")
    spark.range(9).write.parquet(f"{path}/rows/run=20240103/attempt=1")
    found = read_runs(spark, path, schema).groupBy("run").count()
    assert rows(found) == [("2024-01-01", 7), ("20240102", 3)]
    with pytest.raises(ValueError, match="a run is named"):
        write_run(spark.range(1), path, "a/b")
