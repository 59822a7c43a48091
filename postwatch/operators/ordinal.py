"""Row numbers over a whole table, and what follows from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwatch.session import keep

# monotonically_increasing_id counts in the lower 33 bits.
_COUNTER = (1 << 33) - 1


def with_ordinal(df: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """Add each row's 0-based place in the order of the ``order`` columns.

    These columns together must be unique.  The rows are range partitioned and sorted by them
    and stored with partition and place; the partition sizes, one row per partition, then give
    the offsets.  No task sees more than its own range.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = keep(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(_COUNTER))),
        "ordinal",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    # At most one row per partition.
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_place"))
        .drop("_part", "_place", "_offset")
    )


def keys_at(df: DataFrame, key: str, places) -> tuple[int, list]:
    """Number of rows, and the values of the unique ``key`` at the places ``places(n)``.

    Only the key column is sorted.  What comes to the driver is one number and one key per place;
    a place at or after the end gives None.
    """
    numbered = with_ordinal(df.select(key), key)
    n = numbered.count()
    wanted = places(n)
    found = {
        row["ordinal"]: row[key]
        for row in numbered.filter(F.col("ordinal").isin([int(p) for p in set(wanted)])).collect()
    }
    return n, [found.get(p) for p in wanted]


def _before(key: str, border) -> Column:
    # No border means that every row lies before it.
    return F.lit(True) if border is None else F.col(key) < F.lit(border)


def _at(key: str, border) -> Column:
    return F.lit(False) if border is None else F.col(key) == F.lit(border)


def split_positional(
    df: DataFrame, key: str, fraction: float = 0.2, compat: bool = False
) -> DataFrame:
    """Add ``split``: the first ``fraction`` is test, as much again valid, the rest train.

    ``compat`` leaves out the two rows at the borders, as older data sets were cut.  The borders
    are found on the key alone; the wide rows are then split by comparing keys, without a shuffle.
    """
    n, (first, second) = keys_at(
        df, key, lambda n: [math.floor(n * fraction), 2 * math.floor(n * fraction)]
    )
    split = (
        F.when(_before(key, first), "test").when(_before(key, second), "valid").otherwise("train")
    )
    out = df.withColumn("split", split)
    if compat:
        out = out.filter(~(_at(key, first) | _at(key, second)))
    return out


def split_head(df: DataFrame, key: str, fraction: float = 0.6) -> DataFrame:
    """Add ``split``: the first ``ceil(fraction * n)`` rows are train, the others test."""
    _, (border,) = keys_at(df, key, lambda n: [math.ceil(n * fraction)])
    return df.withColumn("split", F.when(_before(key, border), "train").otherwise("test"))


def split_tail(df: DataFrame, key: str, fraction: float = 0.2) -> DataFrame:
    """Add ``split``: the last ``floor(fraction * n)`` rows are valid, the others train."""
    _, (border,) = keys_at(df, key, lambda n: [n - math.floor(n * fraction)])
    return df.withColumn("split", F.when(_before(key, border), "train").otherwise("valid"))


def split_hash(df: DataFrame, key: str, fraction: float = 0.2) -> DataFrame:
    """Add ``split`` by the hash of the key: about ``fraction`` is valid.

    Needs no order, no count and no shuffle, and a row keeps its side when rows are added.
    """
    # The first digits of md5, so that other engines can make the same split.
    digits = F.substring(F.md5(F.col(key).cast("string")), 1, 8)
    bucket = F.conv(digits, 16, 10).cast("long") % 10000
    valid = bucket < round(fraction * 10000)
    return df.withColumn("split", F.when(valid, "valid").otherwise("train"))
