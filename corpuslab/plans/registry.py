"""Named queries with the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuslab.session import spread

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its own name; without SQL, tests hold it against fixtures."""

        def add(fn: Query) -> Query:
            self.queries[fn.__name__] = fn
            if sql:
                self.oracles[fn.__name__] = sql
            return fn

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table for work on whole texts: dealt over all cores where its files are few."""
    return spread(table(spark, sf_dir, name))
