"""Windowed counts and de-duplication on a stream (additions to the batch roll-ups)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postwatch.functions import clock
from postwatch.plans import ingest, partials
from postwatch.sources import messages
from postwatch.streaming.ingest import BATCH_SECONDS, _trigger

# How late a post may be.
LATENESS = "1 hour"
# Parts that copies of one post are spread over.
SALTS = 32


def window_counts(
    rows: DataFrame, *keys: str, ts: str = "ts", day_start: str | None = None,
    lateness: str = LATENESS,
) -> DataFrame:
    """Rows per six-hour window and key, given out once a window can get no more rows.

    The state is one count per open window and key.
    """
    window = F.window(F.col(ts), clock.WINDOW, startTime=day_start)
    return (
        rows.withWatermark(ts, lateness)
        .groupBy(window.alias("w"), *keys)
        .agg(F.count("*").alias("mentions"))
        .select(F.col("w.end").alias("window_end"), *keys, "mentions")
    )


def distinct_posts(rows: DataFrame, key: str = "id_str", ts: str = "ts",
                   lateness: str = LATENESS) -> DataFrame:
    """One row of each id; ids are remembered for the time a repeat may come late.

    Copies of one id are first dropped among the rows of the same part of the input, spread over
    ``SALTS`` tasks, so a post sent very often is no hot spot for the second step.
    """
    salted = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return (
        salted.withWatermark(ts, lateness)
        .dropDuplicatesWithinWatermark([key, "_salt"])
        .drop("_salt")
        .dropDuplicatesWithinWatermark([key])
    )


def start_rollups(
    stream: DataFrame, settings: ingest.Settings, folder: str, checkpoint: str, source: str = "stream",
    once: bool = False, seconds: int = BATCH_SECONDS, day_start: str | None = clock.DAY_START,
) -> StreamingQuery:
    """Decode messages and add each micro-batch to the store of partial counts at ``folder``.

    The batch goes in under ``source`` and its number, so a batch that is run again after a failure counts
    once.  No state is kept for windows: a post of any age corrects its own window.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        posts = messages.good(batch)
        derived = ingest.six_tables(posts, settings)
        partials.add(derived, folder, f"{source}-{batch_id}", day_start)

    writer = messages.decode(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, once, seconds).start()
