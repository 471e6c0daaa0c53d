"""FN-23, FN-24, AGG-16: vectors in array columns: products, norms, sums and means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """L2-normalised; the zero vector stays."""
    # the norm is bound once by an outer lambda: inside the inner one it would be computed for each component
    by = lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(a.cast("array<double>"))
    return F.transform(F.array(norm(a)), by)[0]


def cosine(a: Column, b: Column) -> Column:
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def mean_vectors(rows: DataFrame, keys: list[str], vector: str, name: str = "centroid") -> DataFrame:
    """The mean vector of each group. Components are averaged by position with partial sums on the map side."""
    parts = rows.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return parts.groupBy(*keys).agg(F.transform(ordered, lambda p: p["x"]).alias(name))
