"""Filters and flat tables over nested posts (``schemas.POST``).

The flat tables take the names of further columns of the posts to ``carry`` along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.functions import text as X
from postwatch.operators.lookup import BROADCAST_BYTES, lookup_join

FULL_TEXT = "extended_tweet.full_text"
HASHTAGS = "extended_tweet.entities.hashtags"


def drop_retweets(posts: DataFrame) -> DataFrame:
    """Keep posts that are not marked as retweets and carry no retweeted post; no mark means no retweet."""
    marked = F.coalesce(F.col("retweeted"), F.lit(False))
    return posts.filter(~marked & F.col("retweeted_status").isNull())


def with_extended_text(posts: DataFrame) -> DataFrame:
    return posts.filter(F.col("extended_tweet").isNotNull())


def containing_terms(posts: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Posts in whose text one of the terms occurs, also inside a longer word."""
    return posts.filter(X.contains_any(F.col(FULL_TEXT), terms))


def tracked(posts: DataFrame, terms: Sequence[str], lang: str = "en") -> DataFrame:
    """Posts of one language that mention a term: what a tracking subscription delivers."""
    return containing_terms(posts.filter(F.col("user.lang") == lang), terms)


def flat_posts(posts: DataFrame) -> DataFrame:
    """One flat row per post, table ``tweet``."""
    return posts.select(
        F.col("id_str").alias("twitter_id"),
        F.col("user.id_str").alias("user_twitter_id"),
        F.col(FULL_TEXT).alias("full_text"),
        F.col("retweeted").alias("is_retweet"),
        F.col("in_reply_to_screen_name").isNotNull().alias("is_reply"),
        F.col("favorited").alias("is_favorite"),
        F.lit(False).alias("is_decomposed"),
        F.current_timestamp().alias("inserted_tweet"),
        F.lit("").alias("used_tweet"),
    )


def tagged_posts(
    posts: DataFrame, terms: Sequence[str], carry: Sequence[str] = ()
) -> DataFrame:
    """One row per post and matched term, table ``tb_tweet``.

    The text is stored with the characters blanked that were ignored in the search.
    """
    blanked = posts.withColumn("tweet", X.blank(F.col(FULL_TEXT), X.TERM_BLANKED))
    return blanked.select(
        F.col("id_str").alias("id"),
        F.col("user.screen_name").alias("user"),
        F.col("created_at").alias("timestamp"),
        "tweet",
        F.explode(X.matched_terms(F.col("tweet"), terms)).alias("disease"),
        "favorited",
        F.col("in_reply_to_screen_name").alias("reply"),
        "retweeted",
        *carry,
    )


def tagged_posts_by_union(posts: DataFrame, terms: Sequence[str]) -> DataFrame:
    """The same rows as ``tagged_posts`` from one pass per term, put together by union."""
    parts = [tagged_posts(posts, [term]) for term in terms]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hashtag_rows(posts: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per post and hashtag, table ``tb_hashtag``.

    The time goes along through the explode, so nothing is joined or shuffled.
    """
    return posts.filter(F.size(HASHTAGS) > 0).select(
        F.col("id_str").alias("id_tweet"),
        F.explode(F.col(f"{HASHTAGS}.text")).alias("hashtag"),
        F.col("created_at").alias("timestamp"),
        *carry,
    )


def explode_keywords(
    rows: DataFrame, text: Column, stop_words: Sequence[str], name: str = "keyword"
) -> DataFrame:
    """One row per keyword occurrence in ``text``, with the columns of ``rows``.

    The same as exploding ``text.keywords``; as rows instead of arrays, the rules run in compiled
    code.  Columns dropped afterwards, such as the text, are not carried through the explodes.
    """
    carried = rows.columns
    tokens = rows.select("*", F.explode(F.split(text, X.SPACE + "+")).alias("_token"))
    words = tokens.filter(X.is_keyword_token(F.col("_token"))).select(
        *carried, F.explode(X.keyword_parts(F.col("_token"))).alias("_word")
    )
    return words.filter(X.is_keyword(F.col("_word"), stop_words)).select(
        *carried, F.lower("_word").alias(name)
    )


def keyword_rows(
    posts: DataFrame, stop_words: Sequence[str], carry: Sequence[str] = ()
) -> DataFrame:
    """One row per post and keyword occurrence, table ``tb_keyword``."""
    rows = posts.select(
        F.col("id_str").alias("id_tweet"), F.col("created_at").alias("timestamp"),
        F.col(FULL_TEXT).alias("_text"), *carry,
    )
    words = explode_keywords(rows, F.col("_text"), stop_words)
    return words.select("id_tweet", "keyword", "timestamp", *carry)


def join_times(rows: DataFrame, posts: DataFrame) -> DataFrame:
    """Attach each post's time to rows keyed by ``id_tweet`` where it was not carried along.

    An id that occurs n times in ``posts`` multiplies its rows by n.
    """
    times = posts.select(F.col("id_str").alias("id_tweet"), F.col("created_at").alias("timestamp"))
    return rows.join(times, "id_tweet", "inner")


def without_stop_words(
    words: DataFrame, stop_words: DataFrame, column: str = "word", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Rows whose upper-case word is not in the table of stop words (column ``word``)."""
    stops = stop_words.select(F.col("word").alias(column)).distinct()
    return lookup_join(words, stops, column, words.columns, "left_anti", limit)


def user_rows(posts: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One user record per post, table ``tb_user``; the location is still the user's own text."""
    return posts.select(
        F.col("id_str").alias("id_tweet"),
        F.col("user.id_str").alias("id_user"),
        F.col("user.name").alias("name"),
        F.col("user.screen_name").alias("screen_name"),
        F.col("user.description").alias("description"),
        F.col("user.lang").alias("lang"),
        F.col("user.location").alias("location"),
        F.col("created_at").alias("timestamp"),
        *carry,
    )
