"""Counts per six-hour window.

Each roll-up takes rows with a real timestamp column ``ts`` and gives all windows in one pass.
The hash aggregation counts before the shuffle, so a hot term or user costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postwatch.functions import clock


def in_range(df: DataFrame, start: Column, end: Column, ts: str = "ts") -> DataFrame:
    return df.filter(clock.between(F.col(ts), start, end))


def in_last_window(df: DataFrame, end: Column, ts: str = "ts") -> DataFrame:
    """Rows of the six hours before ``end``."""
    return in_range(df, end - F.expr(f"INTERVAL {clock.WINDOW}"), end, ts)


def ended(df: DataFrame, day_start: str | None = None, ts: str = "ts") -> DataFrame:
    """Add the ``window_end`` of each row."""
    return df.withColumn("window_end", clock.window_end(F.col(ts), day_start))


def ended_at(df: DataFrame, start: Column, end: Column, ts: str = "ts") -> DataFrame:
    """The rows of one window of any length, stamped with its end."""
    return in_range(df, start, end, ts).withColumn("window_end", end)


def counts(
    df: DataFrame, *keys: str, day_start: str | None = None, ts: str = "ts", n: str = "mentions"
) -> DataFrame:
    """Rows per window end, and per key if there are any."""
    return counts_by_end(ended(df, day_start, ts), *keys, n=n)


def counts_by_end(windowed: DataFrame, *keys: str, n: str = "mentions") -> DataFrame:
    return windowed.groupBy("window_end", *keys).agg(F.count("*").alias(n))


def zero_filled(counted: DataFrame, n: str = "tcount") -> DataFrame:
    """Counts per window, with a 0 for each window without rows between the first and the last.

    Each window stands for itself and for the empty ones up to the next.  The order is over one row
    per window, and the rows behind the counts are read once.
    """
    step = F.expr(f"INTERVAL {clock.WINDOW}")
    following = F.lead("window_end").over(Window.orderBy("window_end"))
    last = F.coalesce(following - step, F.col("window_end"))
    return counted.select(
        F.col("window_end").alias("_counted"), n, F.sequence("window_end", last, step).alias("_ends")
    ).select("_counted", n, F.explode("_ends").alias("window_end")).select(
        "window_end", F.when(F.col("window_end") == F.col("_counted"), F.col(n)).otherwise(0).alias(n)
    )


def range_ends(spark: SparkSession, start: Column, end: Column, day_start: str | None = None) -> DataFrame:
    """``window_end`` of every window that the range ``[start, end)`` touches, one row each."""
    first = clock.window_end(F.col("a"), day_start)
    last = clock.window_end(F.col("b") - F.expr("INTERVAL 1 MICROSECOND"), day_start)
    # A window is worked out per row, so the borders are columns of one row.
    borders = spark.range(1).select(start.alias("a"), end.alias("b")).filter("a < b")
    firsts = borders.select("b", first.alias("first"))
    both = firsts.select("first", last.alias("last"))
    return both.select(F.explode(F.sequence("first", "last", F.expr(f"INTERVAL {clock.WINDOW}"))).alias("window_end"))


def filled_range(counted: DataFrame, ends: DataFrame, n: str = "tcount") -> DataFrame:
    """A count for each window of ``ends``, 0 where there is none; both have one row per window."""
    return ends.join(counted, "window_end", "left").select("window_end", F.coalesce(n, F.lit(0)).alias(n))


def user_counts(df: DataFrame, day_start: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows per window and user, with the user's earliest screen name and location in it.

    Rows need ``id_user, screen_name, location`` and, for the order at equal times, ``id_tweet``.
    """
    return user_counts_by_end(ended(df, day_start, ts), ts)


def user_counts_by_end(windowed: DataFrame, ts: str = "ts") -> DataFrame:
    order = F.struct(ts, "id_tweet")
    return windowed.groupBy("window_end", "id_user").agg(
        F.min_by("screen_name", order).alias("user_name"),
        F.min_by("location", order).alias("user_location"),
        F.count("*").alias("mentions"),
    )
