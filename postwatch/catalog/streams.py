"""Queries that run a stream to the end of its input; the result is what it has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch import schemas
from postwatch.catalog import base as B
from postwatch.catalog.base import query
from postwatch.catalog.sources import TABLE_COUNTS, settings, table_counts
from postwatch.functions import clock
from postwatch.operators import posts as P
from postwatch.plans import ingest as tables_plan
from postwatch.session import new_folder
from postwatch.sources import messages
from postwatch.streaming import ingest, rollup


def message_folder(posts: DataFrame) -> str:
    """Posts as JSON messages in text files."""
    folder = new_folder(posts.sparkSession, "messages")
    messages.encode(posts.select(*schemas.POST.fieldNames())).write.text(folder)
    return folder


def finish(query_) -> None:
    query_.awaitTermination()


@query(
    "stream_ingest",
    f"""WITH {B.OWN}
SELECT id_str, created_at, screen_name, full_text FROM own""",
)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = messages.stream_from_files(spark, message_folder(B.posts(spark, sf_dir)), max_files=2)
    own = P.drop_retweets(messages.good(messages.decode(stream))).select(
        "id_str", "created_at", "user.screen_name", F.col(P.FULL_TEXT).alias("full_text")
    )
    folder = new_folder(spark, "ingested")
    finish(ingest.start_copy(own, folder, new_folder(spark, "checkpoint"), once=True))
    return spark.read.parquet(folder)


@query("stream_fanout", TABLE_COUNTS)
def stream_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = messages.stream_from_files(spark, message_folder(B.posts(spark, sf_dir)), max_files=4)
    folder = new_folder(spark, "tables")
    finish(
        ingest.start_ingest(stream, settings(), folder, new_folder(spark, "checkpoint"), once=True)
    )
    return table_counts(spark, folder, sorted(tables_plan.TIMED))


@query(
    "stream_publish",
    f"""WITH {B.POSTS}
SELECT id_str, created_at FROM posts""",
)
def stream_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = messages.stream_from_files(spark, message_folder(B.posts(spark, sf_dir)), max_files=2)
    posts = messages.good(messages.decode(stream))
    folder = new_folder(spark, "published")
    finish(ingest.start_publish(posts, folder, new_folder(spark, "checkpoint"), once=True))
    return messages.good(messages.decode(spark.read.text(folder))).select("id_str", "created_at")


@query(
    "stream_rollup",
    f"""WITH {B.POSTS},
s AS (SELECT date_trunc('second', ts) AS ts, disease FROM ({B.sql_tagged("posts")})),
w AS (SELECT {B.sql_end("ts")} AS e, disease, count(*) AS mentions FROM s GROUP BY ALL)
SELECT {B.sql_moment("e")} AS window_end, disease, mentions FROM w
WHERE e <= (SELECT max(ts) FROM s) - INTERVAL 1 HOUR""",
)
def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that are over at the end of the stream.

    All files come as one batch, as they are not in the order of time.
    """
    stream = messages.stream_from_files(spark, message_folder(B.posts(spark, sf_dir)))
    tagged = P.tagged_posts(messages.good(messages.decode(stream)), B.TERMS)
    timed = tagged.withColumn("ts", clock.parse_created_at(F.col("timestamp")))
    counted = rollup.window_counts(timed, "disease")
    folder = new_folder(spark, "rollup")
    finish(ingest.start_copy(counted, folder, new_folder(spark, "checkpoint"), once=True))
    return spark.read.parquet(folder).withColumn("window_end", B.moment(F.col("window_end")))


@query("stream_dedup", f"WITH {B.POSTS}\nSELECT id_str, created_at FROM posts")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message is sent twice."""
    posts = B.posts(spark, sf_dir)
    stream = messages.stream_from_files(spark, message_folder(posts.unionByName(posts)))
    timed = messages.good(messages.decode(stream)).select(
        "id_str", "created_at", clock.parse_created_at(F.col("created_at")).alias("ts")
    )
    folder = new_folder(spark, "distinct")
    distinct = rollup.distinct_posts(timed)
    finish(ingest.start_copy(distinct, folder, new_folder(spark, "checkpoint"), once=True))
    return spark.read.parquet(folder).select("id_str", "created_at")
