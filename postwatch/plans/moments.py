"""What a Gaussian naive Bayes model is made of, as moments that are merged batch by batch.

A batch gives the number of rows, the mean and the sum of squared differences from it, per class and place of the
vectors.  Batches are published under their names in one transaction each, the same batch again takes its own place, and the
merged moments are those of all rows together: the squares of a batch count from its own mean, so nothing large
is subtracted from something large.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postwatch.sources import transaction

STORE = "moments"
SCHEMA = "store string, label int, pos int, n long, mean double, squares double"
#: Share of the greatest variance that each variance is raised by, so that none is 0.
LEAST_VARIANCE = 1e-9


def moments(df: DataFrame, label: str, vec: str) -> DataFrame:
    """``(label, pos, n, mean, squares)``; made in the tasks first, so a hot class costs a row per task and place."""
    cells = df.select(F.col(label).cast("int").alias("label"), F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "x"))
    return cells.groupBy("label", "pos").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("squares")
    )


def merge(parts: DataFrame) -> DataFrame:
    """Moments of all rows from those of parts of them."""
    whole = Window.partitionBy("label", "pos")
    mean = F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)
    return (
        parts.withColumn("_m", mean)
        .groupBy("label", "pos")
        .agg(F.sum("n").alias("n"), F.first("_m").alias("mean"),
             F.sum(F.col("squares") + F.col("n") * (F.col("mean") - F.col("_m")) ** 2).alias("squares"))
    )


def add(df: DataFrame, folder: str, batch: str, label: str = "label", vec: str = "vec") -> bool:
    """Add a batch of labelled vectors; gives False if it has been folded already."""
    if batch in transaction.replaced(folder):
        return False
    rows = moments(df, label, vec).select(F.lit(STORE).alias("store"), "label", "pos", "n", "mean", "squares")
    transaction.write(rows, folder, batch)
    return True


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``(label, pos, n, mean, variance)`` of all rows so far."""
    merged = merge(transaction.read(spark, folder, STORE, SCHEMA))
    return merged.select("label", "pos", "n", "mean", (F.col("squares") / F.col("n")).alias("variance"))


def compact(spark: SparkSession, folder: str) -> int:
    """Fold all batches into one; gives their number."""
    labels = sorted(transaction.visible(folder))
    if len(labels) > 1:
        folded = merge(transaction.read(spark, folder, STORE, SCHEMA, labels)).withColumn("store", F.lit(STORE))
        rows = folded.select("store", "label", "pos", "n", "mean", "squares")
        transaction.write(rows, folder, f"fold-{uuid.uuid4().hex}", labels)
    return len(labels)


def start_moments(
    stream: DataFrame, folder: str, checkpoint: str, label: str = "label", vec: str = "vec", source: str = "stream"
) -> StreamingQuery:
    """Add each micro-batch of a stream; what is there is taken, then the stream ends."""

    def write(batch: DataFrame, batch_id: int) -> None:
        add(batch, folder, f"{source}-{batch_id}", label, vec)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def predict(rows: DataFrame, stats: DataFrame, key: str, vec: str) -> DataFrame:
    """``(key, prediction)`` by the class of the greatest posterior, the smaller one on ties; ``stats`` as ``read`` gives them.

    One row per class and place is broadcast, whatever the number of rows that were learnt from.
    """
    widest = F.max("variance").over(Window.partitionBy())
    whole = F.sum(F.when(F.col("pos") == 0, F.col("n"))).over(Window.partitionBy())
    variance = F.col("variance") + LEAST_VARIANCE * widest
    table = stats.select(
        "label", "pos", "mean", variance.alias("variance"), F.log(F.col("n") / whole).alias("prior")
    )
    cells = rows.select(key, F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "x"))
    part = -(F.log(2 * math.pi * F.col("variance")) + (F.col("x") - F.col("mean")) ** 2 / F.col("variance")) / 2
    scored = cells.join(F.broadcast(table), "pos").groupBy(key, "label").agg((F.sum(part) + F.first("prior")).alias("score"))
    return scored.groupBy(key).agg(F.max_by("label", F.struct("score", -F.col("label"))).alias("prediction"))
