"""Whitening of embeddings by principal components (operator 11).

1. Entries become integers, floor(scale * entry). The fit list is each distinct integer vector once, written
   to the shared folder; copies collapse in the tasks before anything is shuffled.
2. Sums per dimension are exact. With n vectors and sums S, n * x - S is the exact n-fold deviation of an entry
   from its mean; divided by n it is the centred row, rounded once, however far the mean lies from zero.
3. MLlib's computeSVD over the distributed centred rows: the tasks add up the Gramian, of which the driver
   gets the upper triangle, whatever the number of rows. All singular values are asked for, as the solver is
   then a direct one. Right singular vectors are the components; singular values squared over n their variances.
4. The total variance is the sum of the exact squared deviations over n cubed; it doesn't come from the
   decomposition, so the shares of variance hold even if components are left out.
5. A second look at the whitened fit list says how far its covariance is from the identity.

Defined cases: vectors that are null or hold null or non-finite entries take no part; nor do empty vectors and
vectors of another length than most distinct ones have (of equals the longest); rows with a null key and repeated
rows get rows of their own; entries beyond 64 bits are clipped to them; a deviation of more than 38 digits is null;
components whose variance is within rounding of zero (at most 1e-12 of the total) don't exist, so a table of one
distinct vector or of equal ones gives no rows; of equal variances any basis is right, and the sign is that which makes the
entry of the largest size positive; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import pieces
from corpuslab.llm.topk import takes_part
from corpuslab.session import materialise

#: A component's least share of the total variance; below lies what rounding makes of nothing.
LEAST_SHARE = 1e-12
_LONG, _DIGITS = 1 << 63, 10**38


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums per dimension; components (a column each) and their variances, the largest first."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float = float("nan")


def entries(vector: str, scale: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), width)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: 64-bit integers where all of it fits, else Python's."""
    most = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums), default=0)
    if most < _LONG:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squared(d: np.ndarray) -> list[Decimal | None]:
    """The sum of squares of each row, exactly; null beyond 38 digits."""
    most = max(abs(int(d.max(initial=0))), abs(int(d.min(initial=0))))
    wide = d if most * most * max(1, d.shape[1]) < _LONG else d.astype(object)
    return [Decimal(s) if s < _DIGITS else None for s in map(int, (wide * wide).sum(axis=1))]


def _projected(d: np.ndarray, model: Whitening) -> np.ndarray:
    """Centred rows on the components, each over the root of its variance."""
    return (d / model.n).astype(np.float64) @ model.components / np.sqrt(model.variances)


def _of_fit(fit: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """(centred array<double>, deviation decimal) of each vector of the fit list."""
    width = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, rows=4096):
            d = deviations(_matrix(batch.column(0), width), n, sums)
            flat = pa.array((d / n).astype(np.float64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * width), flat)
            yield pa.RecordBatch.from_arrays([lists, pa.array(squared(d), pa.decimal128(38, 0))], ["centred", "deviation"])

    return fit.mapInArrow(run, "centred array<double>, deviation decimal(38,0)")


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry, by size, of the whitened covariance minus the identity; the tasks' co-moments are centred as they merge."""
    width, k = len(model.sums), len(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, rows=4096):
            w = _projected(deviations(_matrix(batch.column(0), width), model.n, model.sums), model)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in w.T], [f"w{i}" for i in range(k)])

    whitened = fit.mapInArrow(run, ", ".join(f"w{i} double" for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = whitened.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(c - (i == j)) for (i, j), c in zip(pairs, row, strict=True))


def fit(vectors: DataFrame, k: int = 4, scale: int = 256, vector: str = "embedding") -> Whitening | None:
    """The first k components of the distinct integer vectors; None where nothing varies."""
    x = vectors.select(F.col(vector).alias("vector")).filter(takes_part("vector") & (F.size("vector") > 0)).select(entries("vector", scale).alias("x"))
    distinct = materialise(x.distinct(), "fit")
    width = distinct.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if width is None:
        return None
    distinct = distinct.filter(F.size("x") == width["width"])
    sums = distinct.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(19,0)")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("pos").collect()
    n, sums = sums[0]["n"], [int(r["s"]) for r in sums]
    centred = _of_fit(distinct, n, sums)
    exact = centred.agg(F.sum("deviation").alias("all"), F.count_if(F.col("deviation").isNull()).alias("beyond")).first()
    rows = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("centred").alias("v")), "v")
    total = int(exact["all"] or 0) / n**3
    if exact["all"] is None or exact["beyond"]:  # beyond exact digits: the sum of squares of the centred rows
        total = (centred.select(F.aggregate("centred", F.lit(0.0), lambda a, c: a + c * c).alias("s")).agg(F.sum("s")).first()[0] or 0.0) / n
    if not total:
        return None
    svd = RowMatrix(rows, n, len(sums)).computeSVD(len(sums))
    variances = svd.s.toArray() ** 2 / n
    kept = np.flatnonzero(variances > LEAST_SHARE * total)[:k]
    components = svd.V.toArray()[:, kept]
    components = components / np.linalg.norm(components, axis=0)
    components = components * np.sign(components[np.abs(components).argmax(axis=0), np.arange(len(kept))])
    model = Whitening(n, sums, components, variances[kept], total)
    return Whitening(n, sums, components, variances[kept], total, _identity_error(distinct, model))


COLUMNS = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def apply(vectors: DataFrame, model: Whitening | None, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(<key>, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    kind = vectors.select(key).schema[0].dataType.simpleString()
    width = len(model.sums) if model else -1
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")).filter(takes_part("vector") & (F.size("vector") == width)).select("key", entries("vector", scale).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.variances)
        share = model.variances / model.total
        for batch in pieces(batches, rows=4096):
            d = deviations(_matrix(batch.column(1), width), model.n, model.sums)
            m = len(d)
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array(squared(d), pa.decimal128(38, 0)).take(pa.array(each)),
                    pa.array(_projected(d, model).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, model.identity_error)),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    if model is None:
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kind}, {COLUMNS}")
    return rows.mapInArrow(run, f"`{key}` {kind}, {COLUMNS}")
