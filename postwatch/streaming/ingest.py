"""Continuous ingest of messages into the six tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from postwatch.operators import posts as P
from postwatch.plans import ingest
from postwatch.sources import messages

# Seconds between batches of the consumer and of the publisher.
BATCH_SECONDS = 540
ROUND_SECONDS = 90


def _trigger(writer, once: bool, seconds: int):
    if once:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{seconds} seconds")


def start_ingest(
    stream: DataFrame,
    settings: ingest.Settings,
    folder: str,
    checkpoint: str,
    once: bool = False,
    seconds: int = BATCH_SECONDS,
    rollups: str | None = None,
) -> StreamingQuery:
    """Decode messages and write the six tables per batch below ``folder``, and their partial counts to ``rollups``.

    ``once`` takes what is there and ends.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        ingest.ingest_batch(batch, settings, folder, batch_id, rollups)

    writer = (
        messages.decode(stream)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    return _trigger(writer, once, seconds).start()


def start_copy(
    stream: DataFrame, folder: str, checkpoint: str, once: bool = False,
    seconds: int = BATCH_SECONDS,
) -> StreamingQuery:
    """Append a stream to a folder of Parquet files, each row exactly once."""
    writer = (
        stream.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
    )
    return _trigger(writer, once, seconds).start()


def start_publish(
    posts: DataFrame, folder: str, checkpoint: str, once: bool = False,
    seconds: int = ROUND_SECONDS,
) -> StreamingQuery:
    """Publish posts with extended text as JSON messages, one per line.

    The size of a round is set at the source of ``posts``.
    """
    writer = (
        messages.encode(P.with_extended_text(posts))
        .writeStream.format("text")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
    )
    return _trigger(writer, once, seconds).start()


def start_publish_kafka(
    posts: DataFrame, servers: str, topic: str, checkpoint: str, once: bool = False,
    seconds: int = ROUND_SECONDS,
) -> StreamingQuery:
    """The same to a topic.  Needs Spark's Kafka package on the class path."""
    writer = (
        messages.encode(P.with_extended_text(posts))
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )
    return _trigger(writer, once, seconds).start()
