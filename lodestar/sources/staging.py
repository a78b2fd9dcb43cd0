"""Tables written to the cluster's shared checkpoint folder to cut lineage.

A staged table is an ordinary parquet table, so it survives the loss of any
executor and later passes read only the columns they need. It is deleted when the
session's JVM ends, by ``release_staged`` or at the end of a ``staging_scope``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

_staged: list[str] = []


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by the session; local sessions may use their warehouse."""
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staging"


def staging_path(spark: SparkSession) -> str:
    """A fresh path below the staging folder."""
    path = f"{staging_root(spark)}/staged-{uuid.uuid4().hex}"
    folder, files = _hadoop(spark, path)
    files.deleteOnExit(folder)
    _staged.append(path)
    return path


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """The path and its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def stage(df: DataFrame) -> DataFrame:
    """Write the frame once and return a frame that reads it back."""
    path = staging_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_staged(spark: SparkSession) -> None:
    """Delete the tables this process has staged; frames that read them end here."""
    while _staged:
        folder, files = _hadoop(spark, _staged.pop())
        files.delete(folder, True)


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what was staged inside; use its frames within the block."""
    before = len(_staged)
    try:
        yield
    finally:
        while len(_staged) > before:
            folder, files = _hadoop(spark, _staged.pop())
            files.delete(folder, True)
