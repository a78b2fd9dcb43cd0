"""Readers and writers."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def warehouse_table(spark: SparkSession, schema: str, item: str) -> DataFrame:
    """A catalog table by schema and item name."""
    return spark.table(f"`{schema}`.`{item}`")


def inline_table(spark: SparkSession, columns: Sequence[str], rows: list) -> DataFrame:
    """A small literal table."""
    return spark.createDataFrame(rows, list(columns))


def try_types(df: DataFrame, types: T.StructType, strict: bool = False) -> DataFrame:
    """Cast the named columns; a value that does not fit becomes null unless strict."""
    wanted = {f.name: f.dataType for f in types.fields}
    missing = [n for n in wanted if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")

    def typed(name: str) -> Column:
        c = F.col(f"`{name}`")
        if name not in wanted or df.schema[name].dataType == wanted[name]:
            return c
        cast = c.cast(wanted[name]) if strict else c.try_cast(wanted[name])
        return cast.alias(name)

    return df.select(*[typed(n) for n in df.columns])


def read_typed_csv(
    spark: SparkSession,
    path: str,
    types: T.StructType,
    delimiter: str = ",",
    strict: bool = False,
) -> DataFrame:
    """CSV in UTF-8, quotes taken as plain text, typed by the names in its header line.

    Columns not named in ``types`` stay text; a named column the header lacks is an error.
    """
    text = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("encoding", "UTF-8")
        .option("quote", "")
        .option("sep", delimiter)
        .csv(path)
    )
    return try_types(text, types, strict)


def expand_record(
    df: DataFrame, record: str, fields: Sequence[str], names: Sequence[str] | None = None
) -> DataFrame:
    """Replace a struct column by the chosen fields."""
    names = fields if names is None else names
    kept = [F.col(f"`{c}`") for c in df.columns if c != record]
    return df.select(
        *kept,
        *[F.col(record).getField(f).alias(n) for f, n in zip(fields, names, strict=True)],
    )


def expand_json_list(
    df: DataFrame,
    text: str,
    record: T.StructType,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """One row per object of a JSON array held as text, its fields as columns."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != text]
    rows = df.select(
        *kept, F.explode(F.from_json(text, T.ArrayType(record))).alias("_record")
    )
    return expand_record(rows, "_record", record.names, names)


def read_json_list(
    spark: SparkSession, path: str, record: T.StructType, names: Sequence[str] | None = None
) -> DataFrame:
    """Files that each hold one JSON array of objects, one row per object."""
    rows = spark.read.schema(record).option("multiLine", True).json(path)
    return rows if names is None else rows.toDF(*names)


def overwrite(df: DataFrame, path: str) -> DataFrame:
    """Replace the table at the path, schema included, and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_log(df: DataFrame, path: str, run_date: str = "run_date") -> None:
    """Append log rows to a table that is partitioned by the date of the run.

    Rows are rebalanced by date: few files for a small day, many tasks for a large one.
    """
    rows = df.hint("rebalance", run_date)
    rows.write.mode("append").partitionBy(run_date).parquet(path)


def write_run(df: DataFrame, path: str, run: str) -> None:
    """Store the rows of a run so that a repeated or failed run leaves one copy.

    Every attempt writes a folder of its own; the manifest of the run, one small file that is
    written last, names the attempt that counts. Readers see the attempt before until then.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run):
        raise ValueError("a run is named by letters, digits, dot, dash and underscore")
    attempt = uuid.uuid4().hex
    df.write.parquet(f"{path}/rows/run={run}/attempt={attempt}")
    write_text(df.sparkSession, f"{path}/manifest/{run}.json", json.dumps({"run": run, "attempt": attempt}))


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all finished runs, with the ``run`` they are from.

    The manifests choose the folders that are read; a run without one does not exist.
    """
    runs = spark.read.schema("run string, attempt string").json(f"{path}/manifest")
    rows = spark.read.schema(f"{schema}, run string, attempt string").parquet(f"{path}/rows")
    return rows.join(runs, ["run", "attempt"], "left_semi").drop("attempt")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small UTF-8 file on any file system Spark can write to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = files.create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
