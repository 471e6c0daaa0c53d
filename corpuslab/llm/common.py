"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space. ``bytes.split()`` cuts UTF-8 at the same places.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of text that are cut into words or tokens at a time: as Python objects they take some fifteen times as much.
PIECE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, n: int) -> Column:
    """crc32 of a key written as text, modulo n: the fold of a row."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def fresh(name: str, taken: list[str]) -> str:
    """A column name like this one that is not taken; names are the same in any case."""
    low = {c.lower() for c in taken}
    return next(c for c in (name, *(f"{name}_{i}" for i in range(len(low) + 1))) if c.lower() not in low)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512, weight: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a Python worker holds few rows, and few bytes of text, at a time.

    ``weight`` bounds the bytes of a piece unless a single row has more.
    """
    for batch in batches:
        n = batch.num_rows
        step = max(1, min(rows, n * weight // max(1, batch.nbytes)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def utf8(column: pa.Array) -> list[bytes | None]:
    """Text as UTF-8 bytes, null as None."""
    return column.cast(pa.binary()).to_pylist()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)
