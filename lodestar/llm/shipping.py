"""Make this package importable in the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import lodestar

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors the package's source files, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.abspath(lodestar.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "lodestar.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, files in os.walk(top):
            for name in sorted(files):
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    archive.write(file, os.path.relpath(file, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
