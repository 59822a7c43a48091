"""Registry of the subpackage's queries."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


_shipped: set[str] = set()

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts are longer than most rows; Spark's own number of rows would make batches of tens of MB.
TEXT_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application.

    Where it is installed on all machines already, this changes nothing.  Arrow batches get ``TEXT_ROWS``
    rows, unless the session has been given another number.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, TEXT_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    # Made by the driver for the driver's file server; executors fetch it from there.
    archive = Path(tempfile.mkdtemp(prefix="postwatch-code-")) / "postwatch_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL that must give the same rows."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return build(spark, sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
