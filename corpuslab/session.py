"""Session-level helpers: the shared work folder and shipping this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir.

    Only where nothing is set and driver and executors are one process (tests, a laptop) a local folder is made
    and set; a cluster has to name its own.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpuslab-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path below the application's part of the shared folder; nothing is created yet."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/corpuslab/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete what this application has put into the shared folder. Results are lazy: call it when they are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it again.

    This cuts the lineage durably: a lost executor costs only the tasks it ran.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stamps(scan: DataFrame) -> dict[str, str]:
    """The files of a table as they are now: length and time of change of each."""
    spark = scan.sparkSession
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    found = {}
    for name in sorted(scan.inputFiles()):
        path = hadoop.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        found[name] = f"{status.getLen()} {status.getModificationTime()}"
    return found


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer splits than the session has cores, dealt out over all of them; others as they are.

    For work that costs far more than moving its rows, over small inputs in few large row groups.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="corpuslab-"), "corpuslab.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
