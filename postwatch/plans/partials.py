"""Roll-ups as mergeable partial counts, so that late posts correct windows that are already published.

Every batch of posts adds partial counts of the windows it touches, all stores in one transaction under the batch's
name; the same batch again takes its own place.  Readers sum the partials of a window and key.  So the order of
batches does not matter, nor how often one is repeated, and a late post only adds a small partial to
its old window: nothing is counted again.  ``compact`` folds all partials into one per window and key; a batch that
has been folded is known and not added again.

A partial is a number of rows and, for users, the earliest name and location: sums and minima, which can be merged in
any order.  They are made before the shuffle, too, so a hot key costs a row per task.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.functions import clock
from postwatch.operators import rollup
from postwatch.plans.store import KEYED
from postwatch.sources import transaction

FIRST = "struct<ts:timestamp,id:string,name:string,location:string>"
SCHEMA = f"store string, window_end timestamp, key string, n long, first {FIRST}"
STORES = [*(store for store, *_ in KEYED), "users", "tweet_count"]
NAMES = {store: name for store, _, _, name in KEYED} | {"users": "id_user"}


def partials(derived: Mapping[str, DataFrame], day_start: str | None = clock.DAY_START) -> DataFrame:
    """``(store, window_end, key, n, first)`` of the derived tables; a total has a null key."""
    none = F.lit(None)

    def part(store: str, rows: DataFrame, key, first) -> DataFrame:
        ts = F.col("ts").cast("timestamp")
        return rows.select(
            F.lit(store).alias("store"), ts.alias("ts"), key.cast("string").alias("key"), first.cast(FIRST).alias("first")
        )

    user = derived["tb_user"]
    parts = [part(store, derived[table], F.col(key), none) for store, table, key, _ in KEYED]
    parts += [
        part("users", user, F.col("id_user"), F.struct(F.col("ts").cast("timestamp"), "id_tweet", "screen_name", "location")),
        part("tweet_count", derived["tb_tweet"], none, none),
    ]
    windowed = rollup.ended(reduce(DataFrame.unionAll, parts), day_start)
    return windowed.groupBy("store", "window_end", "key").agg(F.count("*").alias("n"), F.min("first").alias("first"))


def merge(rows: DataFrame) -> DataFrame:
    return rows.groupBy("store", "window_end", "key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def add(derived: Mapping[str, DataFrame], folder: str, batch: str, day_start: str | None = clock.DAY_START) -> bool:
    """Add a batch; gives False if it has been folded already, and changes nothing then."""
    if batch in transaction.replaced(folder):
        return False
    transaction.write(partials(derived, day_start), folder, batch)
    return True


def _all(spark: SparkSession, folder: str, labels=None) -> DataFrame:
    parts = [transaction.read(spark, folder, store, SCHEMA, labels) for store in STORES]
    return reduce(DataFrame.unionAll, parts)


def read(spark: SparkSession, folder: str, store: str) -> DataFrame:
    """A store as ``plans.store`` gives it: counts per window and key, or the total of each window, 0 where it is empty."""
    merged = merge(transaction.read(spark, folder, store, SCHEMA))
    if store == "tweet_count":
        return rollup.zero_filled(merged.select("window_end", F.col("n").alias("tcount")))
    named = merged.withColumnRenamed("key", NAMES[store])
    if store == "users":
        return named.select(
            "window_end", "id_user", F.col("first.name").alias("user_name"), F.col("first.location").alias("user_location"),
            F.col("n").alias("mentions"),
        )
    return named.select("window_end", NAMES[store], F.col("n").alias("mentions"))


def compact(spark: SparkSession, folder: str) -> int:
    """Fold all that is published into one partial per window and key; gives the number of labels that were folded.

    Batches may be added meanwhile; they stay beside the fold.  One compaction at a time.
    """
    labels = sorted(transaction.visible(folder))
    if len(labels) > 1:
        folded = merge(_all(spark, folder, labels)).hint("rebalance", "store", "window_end")
        transaction.write(folded, folder, f"fold-{uuid.uuid4().hex}", labels)
    return len(labels)
