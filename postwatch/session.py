"""Session helpers: a local session for tests and benches, and tables kept in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None
# Folders of the tables kept inside each open ``scratch`` block, the innermost last.
_kept: list[list[str]] = []


def local_session(cores: str = "8", app: str = "postwatch", memory: str = "12g") -> SparkSession:
    """A session for one machine.  On a cluster the session comes from spark-submit."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="postwatch-warehouse-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``.

    A temporary folder stands in for it only when the whole session runs on one machine.
    """
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="postwatch-")
    return _local_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the files.

    Later passes read the files instead of running the plan again, the result outlives lost
    executors, and the optimiser knows the real size when it decides on a broadcast.
    """
    path = new_folder(df.sparkSession, name)
    if _kept:
        _kept[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that are kept inside the block at its end, also after a failure.

    For jobs whose results are written when the block ends; what reads a kept table must not leave it.
    Blocks may lie in one another, but not run side by side.
    """
    _kept.append([])
    try:
        yield
    finally:
        for folder in _kept.pop():
            remove(spark, folder)
