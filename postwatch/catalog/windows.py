"""Queries of time ranges, windows and roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.catalog import base as B
from postwatch.catalog.base import query
from postwatch.functions import clock
from postwatch.functions import text as X
from postwatch.operators import posts as P
from postwatch.operators import rollup
from postwatch.plans import partials
from postwatch.session import new_folder
from postwatch.sources import transaction

START, END = "2024-01-02 06:00:00", "2024-01-02 12:00:00"


def _ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _ended(df: DataFrame) -> DataFrame:
    return df.withColumn("window_end", B.moment(F.col("window_end")))


@query(
    "time_range_filter",
    f"""SELECT event_id, event_type, user_id FROM events
WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'""",
)
def time_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.table(spark, sf_dir, "events")
    return rollup.in_range(events, _ntz(START), _ntz(END)).select("event_id", "event_type", "user_id")


@query(
    "trailing_6h",
    f"""SELECT event_type, count(*) AS mentions FROM events
WHERE ts >= TIMESTAMP '{END}' - INTERVAL 6 HOURS AND ts < TIMESTAMP '{END}' GROUP BY ALL""",
)
def trailing_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.table(spark, sf_dir, "events")
    last = rollup.in_last_window(events, _ntz(END))
    return last.groupBy("event_type").agg(F.count("*").alias("mentions"))


@query(
    "window_count",
    f"""SELECT 'full' AS part, count(*) AS tcount FROM events
WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'
UNION ALL
SELECT 'empty', count(*) FROM events
WHERE ts >= TIMESTAMP '1999-01-01 00:00:00' AND ts < TIMESTAMP '1999-01-01 06:00:00'""",
)
def window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.table(spark, sf_dir, "events")
    count = F.count("*").alias("tcount")
    full = rollup.in_range(events, _ntz(START), _ntz(END)).agg(count)
    empty = rollup.in_last_window(events, _ntz("1999-01-01 06:00:00")).agg(count)
    return full.select(F.lit("full").alias("part"), "tcount").unionByName(
        empty.select(F.lit("empty").alias("part"), "tcount")
    )


@query(
    "window_count_zero_filled",
    f"""WITH c AS (SELECT {B.sql_end("ts")} AS e, count(*) AS n FROM events
           WHERE event_type = 'error' AND value > 150 GROUP BY 1),
s AS (SELECT unnest(generate_series((SELECT min(e) FROM c), (SELECT max(e) FROM c),
                                    INTERVAL 6 HOURS)) AS e)
SELECT {B.sql_moment("s.e")} AS window_end, coalesce(n, 0) AS tcount
FROM s LEFT JOIN c ON s.e = c.e""",
)
def window_count_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = B.table(spark, sf_dir, "events")
    rare = events.filter((F.col("event_type") == "error") & (F.col("value") > 150))
    return _ended(rollup.zero_filled(rollup.counts(rare, n="tcount")))


def _windowed(day_start: str | None, origin: str):
    sql = f"""SELECT {B.sql_moment(B.sql_end("ts", origin))} AS window_end, count(*) AS mentions
FROM events GROUP BY 1"""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _ended(rollup.counts(B.table(spark, sf_dir, "events"), day_start=day_start))

    return sql, build


for _name, _day_start, _origin in [
    ("tumbling_6h", None, "2000-01-01 00:00:00"),
    ("tumbling_6h_offset", clock.DAY_START, "2000-01-01 04:00:00"),
]:
    _sql, _build = _windowed(_day_start, _origin)
    query(_name, _sql)(_build)


@query(
    "disease_rollup",
    f"""WITH {B.POSTS}
SELECT {B.sql_moment(B.sql_end("ts"))} AS window_end, disease AS disease_name, count(*) AS mentions
FROM ({B.sql_tagged("posts")}) GROUP BY ALL""",
)
def disease_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = X.blank(F.col(P.FULL_TEXT), X.TERM_BLANKED)
    tagged = B.posts(spark, sf_dir).select(
        "ts", F.explode(X.matched_terms(text, B.TERMS)).alias("disease_name")
    )
    return _ended(rollup.counts(tagged, "disease_name"))


@query(
    "user_rollup",
    f"""SELECT {B.sql_moment(B.sql_end("ts"))} AS window_end, CAST(user_id AS VARCHAR) AS id_user,
       arg_min_null(screen_name, struct_pack(a := ts, b := id)) AS user_name,
       arg_min_null(location, struct_pack(a := ts, b := id)) AS user_location,
       count(*) AS mentions
FROM (SELECT ts, user_id, CAST(event_id AS VARCHAR) AS id,
             'u' || user_id || '_' || coalesce(d.source, '') AS screen_name,
             CASE WHEN event_type <> 'view' THEN json_extract_string(props, '$.k') END AS location
      FROM events LEFT JOIN documents d ON doc_id = event_id)
GROUP BY 1, 2""",
)
def user_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users of all events; those with a document of their number are named by its source."""
    sources = B.table(spark, sf_dir, "documents").select("doc_id", "source")
    events = B.table(spark, sf_dir, "events")
    named = F.concat(F.lit("u"), "user_id", F.lit("_"), F.coalesce("source", F.lit("")))
    users = events.join(sources, events["event_id"] == sources["doc_id"], "left").select(
        "ts", F.col("event_id").cast("string").alias("id_tweet"), F.col("user_id").cast("string").alias("id_user"),
        named.alias("screen_name"),
        F.when(F.col("event_type") != "view", F.get_json_object("props", "$.k")).alias("location"),
    )
    return _ended(rollup.user_counts(users))


@query(
    "keyword_rollup",
    f"""WITH {B.POSTS}
SELECT {B.sql_moment(B.sql_end("ts"))} AS window_end, keyword AS keyword_text, count(*) AS mentions
FROM ({B.sql_keywords("posts")}) GROUP BY ALL""",
)
def keyword_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which keywords were used how often in each window."""
    rows = B.posts(spark, sf_dir).select("ts", F.col(P.FULL_TEXT).alias("text"))
    words = P.explode_keywords(rows, F.col("text"), B.STOP_WORDS, "keyword_text")
    return _ended(rollup.counts(words, "keyword_text"))


@query(
    "hashtag_rollup",
    f"""WITH {B.POSTS}
SELECT {B.sql_moment(B.sql_end("ts"))} AS window_end, hashtag AS hashtag_text, count(*) AS mentions
FROM (SELECT ts, unnest(hashtags) AS hashtag FROM posts) GROUP BY ALL""",
)
def hashtag_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.explode(F.col(f"{P.HASHTAGS}.text")).alias("hashtag_text")
    return _ended(rollup.counts(B.posts(spark, sf_dir).select("ts", tags), "hashtag_text"))


EVENT_ROLLUPS = f"""WITH items AS (
  SELECT 'disease' AS store, ts, event_type AS item, NULL AS name, NULL AS place, 0 AS id FROM events
  UNION ALL SELECT 'keywords', ts, event_type || user_id % 7, NULL, NULL, 0 FROM events
  UNION ALL SELECT 'hashtags', ts, json_extract_string(props, '$.k'), NULL, NULL, 0 FROM events WHERE value > 50
  UNION ALL SELECT 'users', ts, CAST(user_id AS VARCHAR), event_type,
                   CASE WHEN event_type <> 'view' THEN json_extract_string(props, '$.k') END, CAST(event_id AS VARCHAR) FROM events),
total AS (SELECT {B.sql_end("ts")} AS e, count(*) AS n FROM events GROUP BY ALL),
ends AS (SELECT unnest(generate_series(min(e), max(e), INTERVAL 6 HOURS)) AS e FROM total)
SELECT store, {B.sql_moment(B.sql_end("ts"))} AS window_end, item, count(*) AS mentions,
       arg_min_null(name, struct_pack(a := ts, b := id)) AS user_name,
       arg_min_null(place, struct_pack(a := ts, b := id)) AS user_location
FROM items GROUP BY ALL
UNION ALL SELECT 'tweet_count', {B.sql_moment("ends.e")}, NULL, coalesce(n, 0), NULL, NULL FROM ends LEFT JOIN total USING (e)"""


def _event_tables(events: DataFrame) -> dict[str, DataFrame]:
    """Events as derived tables; a post per event."""
    k = F.get_json_object("props", "$.k")
    return {
        "tb_tweet": events.select("ts", F.col("event_type").alias("disease")),
        "tb_keyword": events.select("ts", F.concat("event_type", (F.col("user_id") % 7).cast("string")).alias("keyword")),
        "tb_hashtag": events.filter("value > 50").select("ts", k.alias("hashtag")),
        "tb_user": events.select(
            "ts", F.col("event_id").cast("string").alias("id_tweet"), F.col("user_id").cast("string").alias("id_user"),
            F.col("event_type").alias("screen_name"), F.when(F.col("event_type") != "view", k).alias("location"),
        ),
    }


def _stores(spark: SparkSession, folder: str, read) -> DataFrame:
    def shown(store: str) -> DataFrame:
        rows, users = read(spark, folder, store), store == "users"
        none = F.lit(None).cast("string")
        return rows.select(
            F.lit(store).alias("store"), B.moment(F.col("window_end")).alias("window_end"),
            F.col(partials.NAMES[store]).alias("item") if store in partials.NAMES else none.alias("item"),
            F.col("mentions" if store in partials.NAMES else "tcount").alias("mentions"),
            (F.col("user_name") if users else none).alias("user_name"),
            (F.col("user_location") if users else none).alias("user_location"),
        )

    return reduce(DataFrame.unionAll, map(shown, partials.STORES))


@query("late_rollup", EVENT_ROLLUPS)
def late_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that each reach over all windows come out of order, some twice, with a compaction between them."""
    events, folder = B.table(spark, sf_dir, "events"), new_folder(spark, "partials")

    def add(batch: int) -> None:
        rows = events.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == batch)
        partials.add(_event_tables(rows), folder, f"batch-{batch}", day_start=None)

    for batch in (2, 0, 2):
        add(batch)
    partials.compact(spark, folder)
    for batch in (0, 3, 1, 3):
        add(batch)
    return _stores(spark, folder, partials.read)


@query("rollup_transaction", EVENT_ROLLUPS)
def rollup_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five roll-ups in one transaction; one that fails in a late task goes before it."""
    derived = _event_tables(B.table(spark, sf_dir, "events"))
    rows, folder = partials.partials(derived, day_start=None), new_folder(spark, "transaction")
    broken = rows.withColumn("n", F.when(F.col("store") == "users", F.raise_error(F.lit("stopped"))).otherwise(F.col("n")))
    try:
        transaction.write(broken.repartition(4, "store"), folder, "rollup")
    except Exception as stopped:  # noqa: BLE001
        if "stopped" not in str(stopped):
            raise
    if transaction.visible(folder):
        raise RuntimeError("a failed write is visible")
    transaction.write(rows, folder, "rollup")
    return _stores(spark, folder, partials.read)
