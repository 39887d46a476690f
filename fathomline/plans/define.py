"""Registration of queries beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathomline.session import TABLES, table


class Tables:
    """The tables of a data folder as attributes; nothing is read until a plan needs it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return table(self.spark, self.dir, name)


class Plans:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Register a function of Tables under its own name; without SQL it is tested otherwise."""

        def put(f: Callable[[Tables], DataFrame]):
            self.queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return put
