"""Sinks of the corpus tables (SNK)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.reports import truncated


def parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-01."""
    df.write.mode(mode).parquet(path)


def json_mirror(df: DataFrame, path: str, n: int = 10) -> None:
    """SNK-02: texts cut to their first words."""
    truncated(df, n).write.mode("overwrite").json(path)


def vectors(df: DataFrame, path: str, model: str) -> None:
    """SNK-03: the vector table and a row of statistics."""
    df.write.mode("overwrite").parquet(f"{path}/vectors")
    stored = df.sparkSession.read.parquet(f"{path}/vectors")
    stored.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dimension"), F.lit(model).alias("model"), F.current_timestamp().alias("built")).write.mode("overwrite").json(f"{path}/stats")


def csv(df: DataFrame, path: str) -> None:
    """SNK-05, SNK-07."""
    df.write.mode("overwrite").csv(path, header=True)


def pairs(df: DataFrame, path: str, arrays: tuple[str, ...]) -> None:
    """SNK-06: records as JSON lines, their vectors as Parquet."""
    df.drop(*arrays).write.mode("overwrite").json(f"{path}/records")
    df.select("citation_id", *arrays).write.mode("overwrite").parquet(f"{path}/vectors")


def append(df: DataFrame, path: str) -> None:
    """SNK-08, RET-12: a true append; record and vector are one row and can't part."""
    df.write.mode("append").parquet(path)


def text_lines(df: DataFrame, path: str) -> None:
    """SNK-09, SNK-13."""
    df.coalesce(1).write.mode("overwrite").text(path)
