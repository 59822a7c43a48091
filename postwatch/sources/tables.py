"""Tables: append, per-batch writes, roll-up store, data set splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_table(df: DataFrame, database: str, table: str) -> None:
    """Append to a managed table of a database that is made where it is missing."""
    spark = df.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    df.write.mode("append").format("parquet").saveAsTable(f"{database}.{table}")


def append_bucketed(df: DataFrame, database: str, table: str, key: str, buckets: int) -> None:
    """Append to a managed table whose rows are dealt into ``buckets`` by the hash of ``key`` and sorted by it.

    Tables with the same key and number of buckets are joined, and grouped by the key, without a shuffle.  The rows are
    dealt before the write, so a bucket is one file per append and not one per task.
    """
    spark = df.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    (
        df.repartition(buckets, key).write.mode("append").format("parquet")
        .bucketBy(buckets, key).sortBy(key).saveAsTable(f"{database}.{table}")
    )


def write_batch(
    df: DataFrame, path: str, batch_id: int, time: str | None = None, whole: bool = False
) -> None:
    """Write the rows of one micro-batch; writing the same batch again replaces it.

    With ``whole`` the rows take the place of all batches of the table.

    With ``time``, the name of a timestamp column, the rows are laid out by day, so later range
    filters prune files.  Posts come, and are landed, in the order of time, so a task has rows of
    few days and writes few files; nothing is shuffled for it.
    """
    days: list[str] = []
    if time is not None:
        df = df.withColumn("event_date", F.to_date(time))
        days = ["event_date"]
    (
        df.withColumn("batch_id", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if whole else "dynamic")
        .partitionBy(*days, "batch_id")
        .parquet(path)
    )


def write_rollup(df: DataFrame, path: str) -> None:
    """Write a roll-up by window end; windows in ``df`` replace what was stored for them.

    A job that is run again, or stopped half-way and run again, leaves no doubles.  The rebalance
    gathers a window's rows into few files and splits a window that is too large for one task.
    """
    (
        df.hint("rebalance", "window_end")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("window_end")
        .parquet(path)
    )


def write_run(df: DataFrame, path: str, run: str) -> None:
    """Write a roll-up under the name of a run, beside those of other runs."""
    (
        df.withColumn("run", F.lit(run))
        .hint("rebalance", "window_end")
        .write.mode("append")
        .partitionBy("run")
        .parquet(path)
    )


def write_rollup_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """Append a roll-up to a relational store from the executors.  Needs the store's driver."""
    df.write.jdbc(url, table, mode="append", properties=properties)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """Store a data set by split.  Arrays keep their type."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_split(spark: SparkSession, path: str, name: str, split: str = "split") -> DataFrame:
    """One split of a stored data set; the others are not read."""
    return spark.read.parquet(path).filter(F.col(split) == name).drop(split)


# Less than this per core is spread over all cores.
SPREAD_BYTES = 64 * 1024 * 1024


def spread_small(df: DataFrame, *key: str) -> DataFrame:
    """Spread a table that lies in a few small files over all cores, by the hash of its key.

    One file of one block is read by one task, which then does all the work on its rows.  A table
    of many files, or of much data, comes in many splits and is left as it is, without a shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if len(files) >= cores:
        return df
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0]
    return df.repartition(cores, *key) if size < cores * SPREAD_BYTES else df
