"""Queries of text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.catalog import base as B
from postwatch.catalog.base import query
from postwatch.functions import text as X
from postwatch.functions.contractions import CONTRACTIONS, expand_contractions
from postwatch.operators import features

# The given texts have no apostrophes, links or mentions; frequent words become such.
NOISE = {
    " is ": " can't've ",
    " that ": " That's ",
    " with ": " @cdc ",
    " des ": " http://t.co/x ",
    " und ": " #und ",
    " que ": " you'll ",
    " for ": " y'alls ",
    " von ": " she'd ",
}


def noisy(text: Column) -> Column:
    for old, new in NOISE.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def sql_noisy(text: str) -> str:
    for old, new in NOISE.items():
        old, new = old.replace("'", "''"), new.replace("'", "''")
        text = f"replace({text}, '{old}', '{new}')"
    return text


def sql_expand(text: str, names: list[str]) -> str:
    """Split at the contractions and put the pieces together with their expansions."""
    pattern = "|".join(names).replace("'", "''")
    pairs = ", ".join(
        "'" + k.replace("'", "''") + "': '" + v + "'" for k, v in CONTRACTIONS.items()
    )
    return f"""array_to_string(list_transform(
      list_zip(regexp_split_to_array({text}, '{pattern}'), regexp_extract_all({text}, '{pattern}')),
      lambda p: p[1] || coalesce(MAP {{{pairs}}}[p[2]], '')), '')"""


IN_ORDER = list(CONTRACTIONS)
BY_LENGTH = sorted(CONTRACTIONS, key=len, reverse=True)


@query("tokenize_ws", f"""SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, array_to_string(w, ' ') AS words
FROM (SELECT doc_id, {B.WORDS_OF.format("text")} AS w FROM documents)""")
def tokenize_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = X.tokenize(F.col("text"))
    return B.documents(spark, sf_dir).select(
        "doc_id", F.size(words).alias("n_tokens"), F.array_join(words, " ").alias("words")
    )


@query(
    "expand_contractions",
    f"""WITH n AS (SELECT doc_id, lower({sql_noisy("text")}) AS t FROM documents)
SELECT doc_id, {sql_expand("t", IN_ORDER)} AS expanded FROM n""",
)
def expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lower(noisy(F.col("text")))
    return B.documents(spark, sf_dir).select(
        "doc_id", expand_contractions(text).alias("expanded")
    )


@query(
    "expand_contractions_longest",
    f"""WITH n AS (SELECT doc_id, lower({sql_noisy("text")}) AS t FROM documents)
SELECT doc_id, {sql_expand("t", BY_LENGTH)} AS expanded FROM n""",
)
def expand_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lower(noisy(F.col("text")))
    return B.documents(spark, sf_dir).select(
        "doc_id", expand_contractions(text, longest_first=True).alias("expanded")
    )


_PUNCT = X.PUNCTUATION.replace("'", "''")
CLEANED = f"""WITH n AS (
  SELECT doc_id, regexp_replace(replace(regexp_replace(lower({sql_noisy("text")}),
           'http\\S+', '', 'g'), '#', ''), '@\\S+', '', 'g') AS t FROM documents),
c AS (SELECT doc_id, regexp_replace(translate({sql_expand("t", IN_ORDER)}, '{_PUNCT}', ''),
                                    '^\\s+|\\s+$', '', 'g') AS cleaned FROM n)"""


@query("clean_text", f"{CLEANED}\nSELECT doc_id, cleaned FROM c")
def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.documents(spark, sf_dir).select(
        "doc_id", X.clean_text(noisy(F.col("text"))).alias("cleaned")
    )


@query(
    "longest_text",
    """SELECT doc_id, text, CAST(length(text) AS INTEGER) AS n_chars FROM documents
ORDER BY length(text) DESC, doc_id LIMIT 1""",
)
def longest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.longest_text(B.documents(spark, sf_dir), "doc_id")


@query(
    "max_len_even",
    f"""SELECT CAST(m AS INTEGER) AS max_len, CAST(m + m % 2 AS INTEGER) AS padded_len
FROM (SELECT max(len({B.WORDS_OF.format("text")})) AS m FROM documents)""",
)
def max_len_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.max_tokens(B.documents(spark, sf_dir))


@query(
    "token_lengths",
    f"SELECT doc_id, CAST(len({B.WORDS_OF.format('text')}) AS INTEGER) AS n_tokens FROM documents",
)
def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.token_lengths(B.documents(spark, sf_dir), "doc_id")


@query(
    "token_length_stats",
    f"""SELECT count(*) AS n_texts, CAST(sum(n) AS BIGINT) AS n_tokens, round(avg(n), 6) AS mean_tokens
FROM (SELECT len({B.WORDS_OF.format('text')}) AS n FROM documents)""",
)
def token_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = features.token_lengths(B.documents(spark, sf_dir), "doc_id")
    return lengths.agg(
        F.count("*").alias("n_texts"),
        F.sum("n_tokens").alias("n_tokens"),
        F.round(F.avg("n_tokens"), 6).alias("mean_tokens"),
    )
