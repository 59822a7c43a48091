"""Registry of queries, the tables, and posts derived from them."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.functions import clock
from postwatch.functions.words import read_words
from postwatch.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The stop words are a parameter of the keyword operators.
STOP_WORDS = read_words(Path(__file__).parents[1] / "data" / "stop_words.txt")

# Terms that occur in the given texts.
TERMS = ["that", "with", "und", "des", "que"]


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL that must give the same rows."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(spark, sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The texts.  Work on them is heavy, so a small table is spread over the cores."""
    texts = table(spark, sf_dir, "documents")
    return tables.spread_small(texts.select(*columns) if columns else texts, "doc_id")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.spread_small(table(spark, sf_dir, "conversations"), "conv_id", "turn")


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def moment(ts: Column) -> Column:
    """A timestamp as text, for results."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def joined(array: Column | str) -> Column:
    """An array as text, for results."""
    return F.array_join(F.transform(array, lambda x: x.cast("string")), " ")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A post per document, with the event of the same number, if there is one, as its time and user.

    Columns as in ``schemas.POST``, and ``doc_id`` and ``ts``.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    # Words of six letters or more with a capital stand for hashtags.
    tags = F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0))
    texts = documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    events = table(spark, sf_dir, "events")
    return texts.join(events, texts["doc_id"] == events["event_id"], "left").select(
        "doc_id",
        "ts",
        F.col("doc_id").cast("string").alias("id_str"),
        clock.format_created_at(F.col("ts")).alias("created_at"),
        (F.col("value") > 50).alias("favorited"),
        (F.col("event_type") == "click").alias("retweeted"),
        F.when(k >= 50, F.concat(F.lit("u"), k)).alias("in_reply_to_screen_name"),
        F.when(
            F.col("event_type") == "view", F.struct(F.col("event_id").cast("string").alias("id_str"))
        ).alias("retweeted_status"),
        F.struct(
            F.col("user_id").cast("string").alias("id_str"),
            F.concat(F.lit("User "), "user_id").alias("name"),
            F.concat(F.lit("u"), "user_id", F.lit("_"), "source").alias("screen_name"),
            F.col("source").alias("description"),
            F.col("lang").alias("lang"),
            F.when(F.col("lang") != "es", F.concat(F.lit("  Nation_"), k, F.lit(",  "))).alias(
                "location"
            ),
        ).alias("user"),
        F.struct(
            F.col("text").alias("full_text"),
            F.struct(F.transform(tags, lambda t: F.struct(t.alias("text"))).alias("hashtags")).alias(
                "entities"
            ),
        ).alias("extended_tweet"),
    )


# The same posts, flat.
POSTS = r"""
posts AS (
  SELECT d.doc_id, e.ts, CAST(d.doc_id AS VARCHAR) AS id_str,
         strftime(e.ts, '%a %b %d %H:%M:%S +0000 %Y') AS created_at,
         e.value > 50 AS favorited, e.event_type = 'click' AS retweeted,
         e.event_type = 'view' AS has_status,
         CASE WHEN CAST(json_extract_string(e.props, '$.k') AS INTEGER) >= 50
              THEN 'u' || json_extract_string(e.props, '$.k') END AS reply,
         CAST(e.user_id AS VARCHAR) AS user_id, 'User ' || e.user_id AS user_name,
         'u' || e.user_id || '_' || d.source AS screen_name, d.source AS description, d.lang,
         CASE WHEN d.lang <> 'es'
              THEN '  Nation_' || json_extract_string(e.props, '$.k') || ',  ' END AS location,
         d.text AS full_text, d.n_chars,
         regexp_extract_all(d.text, '[A-Z][a-z]{5,}') AS hashtags
  FROM documents d LEFT JOIN events e ON d.doc_id = e.event_id
)"""

# Posts that are no retweets.
OWN = POSTS + r""",
own AS (SELECT * FROM posts WHERE NOT retweeted AND NOT has_status)"""

WORDS_OF = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"

BLANKED = r"translate(full_text, '#,.', '   ')"


def sql_tagged(source: str) -> str:
    """Rows of table tb_tweet from the posts of a common table."""
    words = WORDS_OF.format("tweet")
    return f"""
  SELECT id_str AS id, screen_name AS "user", created_at AS "timestamp", tweet, disease, favorited,
         reply, retweeted, ts
  FROM (SELECT *, unnest(list_filter([{sql_list(TERMS)}], lambda t: list_contains(
                 list_transform({words}, lambda w: lower(w)), t))) AS disease
        FROM (SELECT *, {BLANKED} AS tweet FROM {source}))"""


def sql_keywords(source: str, key: str = "id_str", text: str = "full_text") -> str:
    """Rows ``(key, ts, keyword)`` from the texts of a common table."""
    return rf"""
  SELECT {key}, ts, lower(word) AS keyword
  FROM (SELECT {key}, ts, unnest(regexp_split_to_array(upper(replace(translate(array_to_string(
                 list_filter(regexp_split_to_array({text}, '\s+'), lambda w: length(w) > 2
                   AND NOT starts_with(w, '@') AND NOT starts_with(w, 'http')
                   AND NOT starts_with(w, 'rt') AND NOT starts_with(w, '&')
                   AND NOT ends_with(w, '"')), ' '),
                 ',?/)(!][{{}}#"—|.:–', '                 '), 'ß', 'SS')), '\s+')) AS word
        FROM {source})
  WHERE word <> '' AND word NOT IN ({sql_list(STOP_WORDS)})"""


def sql_end(ts: str, origin: str = "2000-01-01 00:00:00") -> str:
    """End of the six-hour window."""
    return f"time_bucket(INTERVAL 6 HOURS, {ts}, TIMESTAMP '{origin}') + INTERVAL 6 HOURS"


def sql_moment(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"
