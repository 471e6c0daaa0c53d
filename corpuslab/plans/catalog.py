"""Registry of the engine's queries and of the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuslab.plans import analytics_queries, file_queries, more_queries, retrieval_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]

_REGISTRIES = (retrieval_queries.registry, analytics_queries.registry, text_queries.registry, more_queries.registry, file_queries.registry)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for registry in _REGISTRIES:
        found |= registry.queries
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for registry in _REGISTRIES:
        found |= registry.oracles
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["rrf_hybrid"](spark, sf_dir)
