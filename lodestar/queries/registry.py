"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self._folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        table = read_table(self.spark, self._folder, name)
        setattr(self, name, table)
        return table

    @property
    def daily_orders(self) -> DataFrame:
        """Orders with the order date as a date."""
        return self.orders.withColumn("day", F.to_date("o_orderdate"))


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a function of the tables under its own or the given name."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__doc__ = fn.__doc__
        key = name or fn.__name__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def iso(day: Column | str) -> Column:
    """A date as text, so that both engines print it alike."""
    return F.date_format(day, "yyyy-MM-dd")


def cents(c: Column) -> Column:
    """A floating sum rounded to two places."""
    return F.round(c, 2)
