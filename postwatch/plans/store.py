"""The roll-up store: five counts per window from the derived tables.

The tables carry a timestamp ``ts``, so a time range reaches their files.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.functions import clock
from postwatch.operators import rollup
from postwatch.sources import tables

TABLES = ["tb_tweet", "tb_user", "tb_keyword", "tb_hashtag"]

# Store table, key column of the derived table, name of the key in the store.
KEYED = [
    ("disease", "tb_tweet", "disease", "disease_name"),
    ("keywords", "tb_keyword", "keyword", "keyword_text"),
    ("hashtags", "tb_hashtag", "hashtag", "hashtag_text"),
]


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}


def _keyed_counts(ended: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    out = {
        store: rollup.counts_by_end(ended[table], key).withColumnRenamed(key, name)
        for store, table, key, name in KEYED
    }
    out["users"] = rollup.user_counts_by_end(ended["tb_user"])
    return out


def backfill(
    derived: Mapping[str, DataFrame],
    start: Column | None = None,
    end: Column | None = None,
    day_start: str | None = clock.DAY_START,
) -> dict[str, DataFrame]:
    """Roll-ups of all six-hour windows, or of those in a range, at once; one pass per table.

    With both borders given the total has a row for every window of the range, also where the range is
    wider than the data or empty.  With one border or none it goes from the first window with rows to
    the last.
    """
    if start is not None:
        derived = {name: rows.filter(F.col("ts") >= start) for name, rows in derived.items()}
    if end is not None:
        derived = {name: rows.filter(F.col("ts") < end) for name, rows in derived.items()}
    ended = {name: rollup.ended(rows, day_start) for name, rows in derived.items()}
    total = rollup.counts_by_end(ended["tb_tweet"], n="tcount")
    if start is not None and end is not None:
        ends = rollup.range_ends(total.sparkSession, start, end, day_start)
        return {**_keyed_counts(ended), "tweet_count": rollup.filled_range(total, ends)}
    return {**_keyed_counts(ended), "tweet_count": rollup.zero_filled(total)}


def one_window(derived: Mapping[str, DataFrame], start: Column, end: Column) -> dict[str, DataFrame]:
    """Roll-ups of one window of any length; the total is there even if it is 0."""
    ended = {name: rollup.ended_at(rows, start, end) for name, rows in derived.items()}
    total = ended["tb_tweet"].agg(F.count("*").alias("tcount")).withColumn("window_end", end)
    return {**_keyed_counts(ended), "tweet_count": total.select("window_end", "tcount")}


def last_window(derived: Mapping[str, DataFrame], end: Column) -> dict[str, DataFrame]:
    """Roll-ups of the six hours before ``end``."""
    return one_window(derived, end - F.expr(f"INTERVAL {clock.WINDOW}"), end)


RUNS = "published"


def update_store(counted: Mapping[str, DataFrame], folder: str) -> None:
    """Write roll-ups; they take the place of all that was stored for the windows of their total.

    All tables are written under a new run first.  The run is then published by one small table, a row
    per window; until then readers see what was there before, so a job that stops half-way changes
    nothing, and a window that has lost its rows is empty afterwards.  One job at a time writes a store.
    """
    run = uuid.uuid4().hex
    for name, rows in counted.items():
        tables.write_run(rows, f"{folder}/{name}", run)
    spark = counted["tweet_count"].sparkSession
    windows = spark.read.parquet(f"{folder}/tweet_count").filter(F.col("run") == run).select("window_end", "run")
    windows.withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/{RUNS}")


def read_store(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the store: of each window the rows of the run published last."""
    latest = (
        spark.read.parquet(f"{folder}/{RUNS}")
        .groupBy("window_end")
        .agg(F.max_by("run", F.struct("published_at", "run")).alias("run"))
    )
    return spark.read.parquet(f"{folder}/{name}").join(latest, ["window_end", "run"], "left_semi").drop("run")
