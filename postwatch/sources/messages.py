"""JSON messages: encode, decode, publish, land."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwatch import schemas
from postwatch.operators import posts as P

# How many records one round publishes.
ROUND_CAP = 200

BAD = "bad_record"
# The text a record came as, with the fields outside the schema too.
SOURCE = "source_text"
# Fields without which a text is no post.
REQUIRED = ("id_str",)


def source_text(records: DataFrame) -> Column:
    """The text the records came as; JSON of their columns where they did not come as text."""
    if SOURCE in records.columns:
        return F.col(SOURCE)
    return F.to_json(F.struct(*[c for c in records.columns if c != BAD]))


def encode(records: DataFrame) -> DataFrame:
    """One JSON text ``value`` per record: the text it came as, or its columns without null fields."""
    return records.select(source_text(records).alias("value"))


def decode(messages: DataFrame, schema: T.StructType = schemas.POST, column: str = "value",
           keep_columns: tuple[str, ...] = (), required: Sequence[str] = REQUIRED) -> DataFrame:
    """The fields of ``schema``, ``source_text``, and ``bad_record`` with the text of what is no such record.

    A bad message does not fail the batch: filter on ``bad_record`` to put it aside.  A null or empty
    text and a record without a ``required`` field are bad as well; the null text is put aside as the
    empty one.  So every message is either a record or a bad one.
    """
    with_bad = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    parsed = F.from_json(F.col(column), with_bad, {"columnNameOfCorruptRecord": BAD})
    # Behind the explode the text is parsed once, however often the fields are tested.
    rows = messages.select(*keep_columns, F.col(column).alias(SOURCE), F.explode(F.array(parsed)).alias("r"))
    bad = F.col("r").isNull() | F.col(f"r.{BAD}").isNotNull() | (F.trim(SOURCE) == "")
    for name in required:
        bad = bad | F.col(f"r.{name}").isNull()
    aside = F.when(F.coalesce(bad, F.lit(True)), F.coalesce(SOURCE, F.lit("")))
    return rows.select(*keep_columns, *[f"r.{n}" for n in schema.fieldNames()], SOURCE, aside.alias(BAD))


def good(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col(BAD).isNull()).drop(BAD)


def publish_round(posts: DataFrame, order: list[str], cap: int = ROUND_CAP) -> DataFrame:
    """What one round publishes: the first ``cap`` posts with extended text, as messages.

    The cap is the feature.  A stream caps its source instead (``max_offsets``, ``max_files``).
    """
    first = P.with_extended_text(posts).orderBy(*order).limit(cap)
    return first.select(F.col("id_str").alias("key"), source_text(first).alias("value"))


def raw_rows(posts: DataFrame) -> DataFrame:
    """Raw landing table: id, whole record as it came, processing time."""
    return posts.select(
        F.col("id_str").alias("twitter_id"),
        source_text(posts).alias("json"),
        F.current_timestamp().alias("inserted_tweet"),
    )


def replay(raw: DataFrame) -> DataFrame:
    """The posts of a raw landing table."""
    return good(decode(raw, column="json"))


def stream_from_kafka(
    spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None
) -> DataFrame:
    """Messages of a topic.  Needs Spark's Kafka package on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
    )
    if max_offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def stream_from_files(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Messages of a folder of text files, one JSON text per line."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)
