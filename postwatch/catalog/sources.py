"""Queries of sources, sinks and formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwatch import schemas
from postwatch.catalog import base as B
from postwatch.catalog.base import query
from postwatch.functions import clock
from postwatch.functions import text as X
from postwatch.operators import ordinal, rollup
from postwatch.operators import posts as P
from postwatch.plans import ingest, store
from postwatch.session import keep, new_folder
from postwatch.sources import delimited, messages, tables, word_vectors


def settings() -> ingest.Settings:
    return ingest.Settings(terms=B.TERMS, stop_words=B.STOP_WORDS)


@query(
    "publish_capped",
    f"""WITH {B.POSTS}
SELECT id_str AS "key", created_at, length(full_text) AS n_chars
FROM posts WHERE n_chars > 140 ORDER BY ts, id_str LIMIT 200""",
)
def publish_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Short posts have no extended text.
    extended = F.when(F.length(P.FULL_TEXT) > 140, F.col("extended_tweet"))
    posts = B.posts(spark, sf_dir).withColumn("extended_tweet", extended)
    published = keep(messages.publish_round(posts, ["ts", "id_str"]), "published")
    return published.select(
        "key",
        F.get_json_object("value", "$.created_at").alias("created_at"),
        F.length(F.get_json_object("value", "$.extended_tweet.full_text")).cast("long")
        .alias("n_chars"),
    )


@query(
    "json_decode",
    """SELECT event_id,
       CASE WHEN event_type <> 'error' AND event_id % 10 > 2
            THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k,
       event_type = 'error' OR event_id % 10 <= 2 AS is_bad
FROM events""",
)
def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.table(spark, sf_dir, "events")
    # Messages of one type have lost their closing brace; others are null, empty, or lack the field.
    cut = F.regexp_replace("props", "[}]$", "")
    digit = F.col("event_id") % 10
    value = (
        F.when(digit == 0, F.lit(None)).when(digit == 1, "").when(digit == 2, "{}")
        .when(F.col("event_type") == "error", cut).otherwise(F.col("props"))
    )
    decoded = messages.decode(
        events.withColumn("value", value), schemas.fields(k=T.IntegerType()), keep_columns=("event_id",), required=["k"]
    )
    bad = F.col(messages.BAD).isNotNull()
    return decoded.select("event_id", F.when(~bad, F.col("k")).alias("k"), bad.alias("is_bad"))


@query(
    "raw_landing",
    f"""WITH {B.OWN}
SELECT id_str AS twitter_id, created_at, screen_name, full_text, doc_id % 7 AS retweet_count,
       doc_id AS place
FROM own""",
)
def raw_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages have fields that no schema names; they land too."""
    more = [(F.col("doc_id") % 7).alias("retweet_count"), F.struct(F.col("doc_id").alias("place")).alias("geo")]
    sent = B.posts(spark, sf_dir).select(F.to_json(F.struct(*schemas.POST.fieldNames(), *more)).alias("value"))
    landed = keep(messages.raw_rows(P.drop_retweets(messages.good(messages.decode(sent)))), "raw_tweet")
    return landed.select(
        "twitter_id",
        F.get_json_object("json", "$.created_at").alias("created_at"),
        F.get_json_object("json", "$.user.screen_name").alias("screen_name"),
        F.get_json_object("json", "$.extended_tweet.full_text").alias("full_text"),
        F.get_json_object("json", "$.retweet_count").cast("long").alias("retweet_count"),
        F.get_json_object("json", "$.geo.place").cast("long").alias("place"),
    )


def table_counts(spark: SparkSession, folder: str, names) -> DataFrame:
    """Rows and posts per table and day of tables below a folder."""
    ids = {"tb_tweet": "id"}
    parts = [
        spark.read.parquet(f"{folder}/{name}").select(
            F.lit(name).alias("table_name"),
            F.date_format("event_date", "yyyy-MM-dd").alias("day"),
            F.col(ids.get(name, "id_tweet")).alias("id"),
        )
        for name in names
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("table_name", "day").agg(
        F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_posts")
    )


TABLE_COUNTS = f"""WITH {B.OWN},
t AS (
  SELECT 'tb_tweet' AS table_name, id, ts FROM ({B.sql_tagged('own')})
  UNION ALL SELECT 'tb_keyword', id_str, ts FROM ({B.sql_keywords('own')})
  UNION ALL SELECT 'tb_hashtag', id_str, ts FROM (SELECT id_str, ts, unnest(hashtags) FROM own)
  UNION ALL SELECT 'tb_user', id_str, ts FROM own)
SELECT table_name, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_rows,
       count(DISTINCT id) AS n_posts
FROM t GROUP BY ALL"""


@query("raw_replay", TABLE_COUNTS)
def raw_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = B.posts(spark, sf_dir).select(*schemas.POST.fieldNames())
    raw = keep(messages.raw_rows(posts), "raw_tweet")
    folder = new_folder(spark, "replay")
    ingest.replay_tables(raw, settings(), folder)
    return table_counts(spark, folder, sorted(ingest.TIMED))


@query(
    "rollup_sink",
    f"""SELECT {B.sql_moment(B.sql_end('ts'))} AS window_end, event_type AS disease_name,
       count(*) AS mentions
FROM events GROUP BY ALL""",
)
def rollup_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = rollup.counts(B.table(spark, sf_dir, "events"), "event_type").withColumnRenamed(
        "event_type", "disease_name"
    )
    folder = new_folder(spark, "disease")
    tables.write_rollup(counted, folder)
    return spark.read.parquet(folder).select(
        B.moment(F.col("window_end")).alias("window_end"), "disease_name", "mentions"
    )


STORE_BACKFILL = f"""WITH {B.OWN},
tagged AS (SELECT disease, ts FROM ({B.sql_tagged('own')})),
items AS (
  SELECT 'disease' AS store, ts, disease AS item FROM tagged
  UNION ALL SELECT 'keywords', ts, keyword FROM ({B.sql_keywords('own')})
  UNION ALL SELECT 'hashtags', ts, unnest(hashtags) FROM own
  UNION ALL SELECT 'users', ts, user_id FROM own),
range AS (SELECT date_trunc('day', min(ts)) - INTERVAL 2 DAYS AS a,
                 date_trunc('day', max(ts)) + INTERVAL 3 DAYS AS b FROM events),
ends AS (SELECT unnest(generate_series(a + INTERVAL 6 HOURS, b, INTERVAL 6 HOURS)) AS e FROM range),
total AS (SELECT {B.sql_end('ts')} AS e, count(*) AS n FROM tagged GROUP BY ALL)
SELECT store, {B.sql_moment(B.sql_end('ts'))} AS window_end, item, count(*) AS mentions FROM items GROUP BY ALL
UNION ALL
SELECT 'tweet_count', {B.sql_moment('ends.e')}, '', coalesce(n, 0) FROM ends LEFT JOIN total USING (e)"""


@query("store_backfill", STORE_BACKFILL)
def store_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five tables over a range wider than the data, written twice and read back."""
    # Posts are joined, and searched for terms, once for both runs; of the tagged posts the roll-ups need no text.
    own = keep(P.drop_retweets(B.posts(spark, sf_dir)), "own")
    derived = {
        "tb_tweet": keep(P.tagged_posts(own, B.TERMS, ["ts"]).drop("tweet"), "tb_tweet"), "tb_user": P.user_rows(own, ["ts"]),
        "tb_keyword": P.keyword_rows(own, B.STOP_WORDS, ["ts"]), "tb_hashtag": P.hashtag_rows(own, ["ts"]),
    }
    events = B.table(spark, sf_dir, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    a, b = events.select(
        F.expr("date_trunc('day', a) - INTERVAL 2 DAYS").cast("timestamp_ntz"),
        F.expr("date_trunc('day', b) + INTERVAL 3 DAYS").cast("timestamp_ntz"),
    ).first()
    borders = [F.lit(x).cast("timestamp_ntz") for x in (a, b)]
    folder = new_folder(spark, "store")
    for _ in range(2):
        store.update_store(store.backfill(derived, *borders, day_start=None), folder)
    names = {"disease": "disease_name", "keywords": "keyword_text", "hashtags": "hashtag_text", "users": "id_user"}
    parts = [
        store.read_store(spark, folder, name).select(
            F.lit(name).alias("store"), B.moment(F.col("window_end")).alias("window_end"),
            F.col(names[name]).alias("item") if name in names else F.lit("").alias("item"),
            F.col("mentions" if name in names else "tcount").alias("mentions"),
        )
        for name in [*names, "tweet_count"]
    ]
    return reduce(DataFrame.unionAll, parts)


@query(
    "labeled_csv_read",
    r"""SELECT regexp_replace(replace(d.text, chr(10), ' '), '^\s+|\s+$', '', 'g') AS tweet,
       l.quality + l.toxic AS label
FROM documents d JOIN labels l USING (doc_id)""",
)
def labeled_csv_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = B.table(spark, sf_dir, "labels")
    rows = B.documents(spark, sf_dir).join(labels, "doc_id").select(
        X.blank(F.col("text"), "\n").alias("tweet"), (F.col("quality") + F.col("toxic")).alias("label")
    )
    folder = new_folder(spark, "labeled")
    delimited.write_delimited(rows, folder, header=True)
    return delimited.read_labeled(spark, folder, header=True)


@query("delimiter_convert", "SELECT doc_id, toxic FROM labels")
def delimiter_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced, piped, commas = (new_folder(spark, n) for n in ("spaced", "piped", "commas"))
    delimited.write_delimited(B.table(spark, sf_dir, "labels"), spaced, sep=" ")
    delimited.convert(spark, spaced, piped, 3, " ", "|")
    delimited.convert(spark, piped, commas, 3, "|", ",", wanted=[0, 2])
    schema = schemas.fields(doc_id=T.LongType(), toxic=T.IntegerType())
    return delimited.read_delimited(spark, commas, schema)


@query(
    "jsonl_to_delimited",
    "SELECT doc_id || '|' || replace(text, chr(10), ' ') AS \"value\" FROM documents",
)
def jsonl_to_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "lines")
    documents = B.documents(spark, sf_dir)
    documents.select(F.col("doc_id").alias("id"), F.col("text").alias("full_text")).write.json(folder)
    return delimited.json_lines_to_delimited(spark, folder)


def vector_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word per stored vector."""
    return B.table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.concat(F.lit("w"), "vec_id").alias("word"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


VECTOR_ROWS = """
  SELECT row_number() OVER (ORDER BY vec_id) AS idx, 'w' || vec_id AS word, len(embedding) AS dims,
         round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total
  FROM embeddings"""


@query(
    "vocab_with_special_rows",
    f"""{VECTOR_ROWS}
UNION ALL SELECT 0, '<EOF>', max(len(embedding)), 0.0 FROM embeddings
UNION ALL SELECT count(*) + 1, '<unk>', max(len(embedding)), 0.0 FROM embeddings""",
)
def vocab_with_special_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "vectors")
    word_vectors.write_word_vectors(vector_words(spark, sf_dir), folder, "vec_id")
    return _vector_rows(word_vectors.read_word_vectors(spark, folder, seed=None))


@query(
    "vocab_from_zero",
    f"""SELECT idx - 1 AS idx, word, dims, total FROM ({VECTOR_ROWS})
UNION ALL SELECT count(*), '<unk>', max(len(embedding)), 0.0 FROM embeddings""",
)
def vocab_from_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "vectors")
    word_vectors.write_word_vectors(vector_words(spark, sf_dir), folder, "vec_id")
    return _vector_rows(word_vectors.read_word_vectors(spark, folder, seed=None, end_word=False))


def _vector_rows(vectors: DataFrame) -> DataFrame:
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    return vectors.select(
        "idx", "word", F.size("vec").cast("long").alias("dims"), F.round(total, 6).alias("total")
    )


@query(
    "split_roundtrip",
    """SELECT CASE WHEN r < t THEN 'test' WHEN r < 2 * t THEN 'valid' ELSE 'train' END AS split,
       vec_id, label, CAST(dims AS BIGINT) AS dims, total
FROM (SELECT vec_id, label, len(embedding) AS dims,
             round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total,
             row_number() OVER (ORDER BY vec_id) - 1 AS r,
             CAST(floor(count(*) OVER () * 0.2) AS BIGINT) AS t
      FROM embeddings)""",
)
def split_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "splits")
    embeddings = B.table(spark, sf_dir, "embeddings")
    tables.write_splits(ordinal.split_positional(embeddings, "vec_id"), folder)
    parts = [
        tables.read_split(spark, folder, name).withColumn("split", F.lit(name))
        for name in ("test", "valid", "train")
    ]
    total = F.aggregate(
        F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(
        "split", "vec_id", "label", F.size("embedding").cast("long").alias("dims"),
        F.round(total, 6).alias("total"),
    )


@query(
    "parse_created_at",
    f"""WITH {B.POSTS}
SELECT doc_id, {B.sql_moment("ts")} AS parsed FROM posts""",
)
def parse_created_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = clock.parse_created_at(F.col("created_at"))
    return B.posts(spark, sf_dir).select("doc_id", B.moment(parsed).alias("parsed"))
