"""Files in the shared folder, written and read by Python workers through Arrow's file systems."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import SparkSession


def make_dir(spark: SparkSession, uri: str) -> str:
    """Create the folder through Hadoop's file system, as the driver can reach any store that way."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return uri


@contextlib.contextmanager
def create(folder: str, stem: str, suffix: str) -> Iterator[tuple[str, BinaryIO]]:
    """Write a new file: (its name, a stream). It gets its name only when it is whole.

    Every attempt of a task writes a name of its own and reports it in its rows; readers open the
    reported names only, so retried and speculative tasks leave orphans but never wrong rows.
    """
    store, root = fs.FileSystem.from_uri(folder)
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    part = f"{root}/_{name}.part"
    with store.open_output_stream(part) as stream:
        yield name, stream
    store.move(part, f"{root}/{name}")


def open_file(folder: str, name: str):
    """A random-access Arrow file."""
    store, root = fs.FileSystem.from_uri(folder)
    return store.open_input_file(f"{root}/{name}")
