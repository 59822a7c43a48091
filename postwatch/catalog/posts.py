"""Queries of filters, flat tables and joins over posts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.catalog import base as B
from postwatch.catalog.base import query
from postwatch.functions import text as X
from postwatch.operators import features, lookup, terms
from postwatch.operators import posts as P
from postwatch.session import keep
from postwatch.sources import tables


@query("drop_retweets", f"WITH {B.OWN}\nSELECT doc_id, created_at FROM own")
def drop_retweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.drop_retweets(B.posts(spark, sf_dir)).select("doc_id", "created_at")


HAS_TERM = " OR ".join(f"contains(lower(text), '{t}')" for t in B.TERMS)


@query("term_substring_filter", f"SELECT doc_id, text FROM documents WHERE {HAS_TERM}")
def term_substring_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = B.documents(spark, sf_dir).select("doc_id", "text")
    return documents.filter(X.contains_any(F.col("text"), B.TERMS))


@query(
    "track_terms_lang",
    f"WITH {B.POSTS}\nSELECT doc_id FROM posts WHERE lang = 'en' AND ({HAS_TERM})".replace(
        "lower(text)", "lower(full_text)"
    ),
)
def track_terms_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tracked(B.posts(spark, sf_dir), B.TERMS).select("doc_id")


@query(
    "flatten_post",
    f"""WITH {B.POSTS}
SELECT id_str AS twitter_id, user_id AS user_twitter_id, full_text, retweeted AS is_retweet,
       reply IS NOT NULL AS is_reply, favorited AS is_favorite, false AS is_decomposed,
       '' AS used_tweet
FROM posts""",
)
def flatten_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Without the time of processing, which differs in each run.
    return P.flat_posts(B.posts(spark, sf_dir)).drop("inserted_tweet")


TAGGED = f"""WITH {B.POSTS}
SELECT id, "user", "timestamp", tweet, disease, favorited, reply, retweeted
FROM ({B.sql_tagged("posts")})"""


@query("term_tagging", TAGGED)
def term_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tagged_posts(B.posts(spark, sf_dir), B.TERMS)


@query("tag_union", TAGGED)
def tag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tagged_posts_by_union(B.posts(spark, sf_dir), B.TERMS)


HASHTAGS = f"""WITH {B.POSTS}
SELECT id_str AS id_tweet, unnest(hashtags) AS hashtag, created_at AS "timestamp" FROM posts"""


@query("hashtag_explode", HASHTAGS)
def hashtag_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.hashtag_rows(B.posts(spark, sf_dir))


@query("hashtag_join", HASHTAGS)
def hashtag_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = B.posts(spark, sf_dir)
    return P.join_times(P.hashtag_rows(posts).drop("timestamp"), posts)


KEYWORDS = f"""WITH {B.POSTS}
SELECT id_tweet, keyword, strftime(ts, '%a %b %d %H:%M:%S +0000 %Y') AS "timestamp"
FROM (SELECT id_str AS id_tweet, ts, keyword FROM ({B.sql_keywords("posts")}))"""


@query("keyword_extract", KEYWORDS)
def keyword_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.keyword_rows(B.posts(spark, sf_dir), B.STOP_WORDS)


@query("keyword_join", KEYWORDS)
def keyword_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = B.posts(spark, sf_dir)
    rows = P.keyword_rows(posts, B.STOP_WORDS).drop("timestamp")
    return P.join_times(rows, posts)


@query(
    "stopword_filter",
    f"""SELECT doc_id, upper(word) AS word
FROM (SELECT doc_id, unnest({B.WORDS_OF.format("replace(text, 'ß', 'SS')")}) AS word FROM documents)
WHERE upper(word) NOT IN ({B.sql_list(B.STOP_WORDS)})""",
)
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = B.documents(spark, sf_dir)
    words = documents.select(
        "doc_id", F.explode(F.transform(X.tokenize(F.col("text")), F.upper)).alias("word")
    )
    stops = spark.createDataFrame([(w,) for w in B.STOP_WORDS], "word STRING")
    return P.without_stop_words(words, stops).select("doc_id", "word")


@query(
    "geo_enrich",
    f"""WITH {B.POSTS},
places AS (
  SELECT lower(n_name) AS location_key, arg_min(s_name, struct_pack(r := -s_acctbal, n := s_name)) AS code
  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT id_str AS id_tweet, user_id AS id_user, user_name AS "name", screen_name, description, lang,
       code AS location, created_at AS "timestamp"
FROM posts LEFT JOIN places
  ON array_to_string({B.WORDS_OF.format("replace(lower(location), ',', '')")}, ' ') = location_key""",
)
def geo_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = B.table(spark, sf_dir, "nation")
    supplier = B.table(spark, sf_dir, "supplier")
    candidates = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(
        F.col("n_name").alias("place"), F.col("s_name").alias("country_code"),
        (-F.col("s_acctbal")).alias("rank"),
    )
    places = keep(lookup.best_places(candidates), "places")
    return lookup.enrich_location(P.user_rows(B.posts(spark, sf_dir)), places)


@query(
    "dim_bridge",
    f"""WITH {B.POSTS},
k AS (SELECT DISTINCT doc_id, keyword FROM ({B.sql_keywords("posts", "doc_id")})),
dim AS (SELECT keyword, row_number() OVER (ORDER BY keyword) AS id
        FROM (SELECT DISTINCT keyword FROM k))
SELECT doc_id, id, keyword FROM k JOIN dim USING (keyword)""",
)
def dim_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = B.documents(spark, sf_dir, "doc_id", "text")
    words = P.explode_keywords(texts, F.col("text"), B.STOP_WORDS).select("doc_id", "keyword")
    pairs = keep(words.distinct(), "pairs")
    dimension = keep(features.term_dimension(pairs, "keyword"), "dimension")
    return features.with_term_ids(pairs, "doc_id", "keyword", dimension)


# Terms of one to three words: all of these that the benchmark texts hold, well over ten thousand on large tables.
GRAMS = f"""w AS (SELECT {B.WORDS_OF.format("lower(translate(text, '#,.', '   '))")} AS words FROM benchmark),
terms AS (SELECT DISTINCT array_to_string(words[i + 1:i + n], ' ') AS term
          FROM (SELECT words, n, unnest(range(len(words) - n + 1)) AS i
                FROM (SELECT words, unnest([1, 2, 3]) AS n FROM w) WHERE len(words) >= n)),
d AS (SELECT conv_id, turn, {B.WORDS_OF.format("lower(translate(text, '#,.', '   '))")} AS words FROM conversations),
hits AS (SELECT conv_id, turn, i AS pos, term
         FROM (SELECT conv_id, turn, i, array_to_string(words[i + 1:i + n], ' ') AS term
               FROM (SELECT *, unnest(range(len(words) - n + 1)) AS i
                     FROM (SELECT *, unnest([1, 2, 3]) AS n FROM d) WHERE len(words) >= n)) JOIN terms USING (term))"""


def _grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = B.table(spark, sf_dir, "benchmark").select(terms.term_words(F.col("text")).alias("words"))
    each = F.flatten(F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.filter(
        F.transform("words", lambda _, i: F.slice(F.col("words"), i + 1, n)), lambda g: F.size(g) == n)))
    return words.select(F.explode(each).alias("g")).select(F.array_join("g", " ").alias("term")).distinct()


@query("phrase_hits", f"WITH {GRAMS}\nSELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, term FROM hits")
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place where a term of a large list stands, terms of several words included."""
    return terms.term_hits(B.conversations(spark, sf_dir), ["conv_id", "turn"], terms.term_trie(_grams(spark, sf_dir)))


@query("phrase_tagging", f"WITH {GRAMS}\nSELECT DISTINCT conv_id, turn, term FROM hits")
def phrase_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.with_terms(B.conversations(spark, sf_dir), ["conv_id", "turn"], terms.term_trie(_grams(spark, sf_dir)))


PLACES = """places AS (
  SELECT lower(n_name) AS key, 'N' || n_nationkey AS code FROM nation
  UNION ALL SELECT lower(n_name || ' ' || r_name), 'NR' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
            WHERE n_nationkey % 2 = 0
  UNION ALL SELECT lower(r_name), 'R' || r_regionkey FROM region)"""


@query(
    "gazetteer",
    f"""WITH {PLACES},
u AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN c_name || ', ' || n_name || ', ' || r_name
               WHEN 1 THEN n_name || ',' || r_name WHEN 2 THEN r_name || ', Nowhere ' || c_custkey
               WHEN 3 THEN 'nowhere' WHEN 4 THEN ' , ' || upper(n_name) || '!!' END AS location
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT c_custkey, list_filter(list_transform(string_split(location, ','), lambda x: array_to_string(
               {B.WORDS_OF.format("regexp_replace(lower(x), '[^a-z0-9_ ]', '', 'g')")}, ' ')), lambda x: x <> '') AS p FROM u),
c AS (SELECT c_custkey, unnest(c) AS key, generate_subscripts(c, 1) AS tried
      FROM (SELECT c_custkey, list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[i:], ' '))
                   || list_transform(range(1, len(p)), lambda i: array_to_string(p[:len(p) - i], ' ')) AS c FROM p)),
f AS (SELECT c_custkey, min(struct_pack(t := tried, k := key, c := code)) AS f FROM c JOIN places USING (key) GROUP BY 1)
SELECT c_custkey, f.c AS country_code, f.k AS matched, CAST(f.t AS INTEGER) AS tried FROM u LEFT JOIN f USING (c_custkey)""",
)
def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations with several candidates, known and unknown ones, found by falling suffixes and fronts."""
    nation, region = B.table(spark, sf_dir, "nation"), B.table(spark, sf_dir, "region")
    both = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    rank = F.lit(1).alias("rank")
    candidates = (
        nation.select(F.col("n_name").alias("place"), F.concat(F.lit("N"), "n_nationkey").alias("country_code"), rank)
        .unionAll(both.filter("n_nationkey % 2 = 0").select(F.concat_ws(" ", "n_name", "r_name"), F.concat(F.lit("NR"), "n_nationkey"), rank))
        .unionAll(region.select("r_name", F.concat(F.lit("R"), "r_regionkey"), rank))
    )
    places = keep(lookup.best_places(candidates), "places")
    customer = B.table(spark, sf_dir, "customer")
    kind = F.col("c_custkey") % 6
    location = (
        F.when(kind == 0, F.concat_ws(", ", "c_name", "n_name", "r_name")).when(kind == 1, F.concat_ws(",", "n_name", "r_name"))
        .when(kind == 2, F.concat("r_name", F.lit(", Nowhere "), "c_custkey")).when(kind == 3, "nowhere")
        .when(kind == 4, F.concat(F.lit(" , "), F.upper("n_name"), F.lit("!!")))
    )
    users = customer.join(both, customer["c_nationkey"] == both["n_nationkey"]).select("c_custkey", location.alias("location"))
    return lookup.locate(users, ["c_custkey"], places)


@query("bucketed_join", HASHTAGS)
def bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times of hashtags from tables that lie in buckets by the post, appended in two parts; nothing is shuffled."""
    posts = B.posts(spark, sf_dir)
    database = f"buckets_{uuid.uuid4().hex}"
    for part in (0, 1):
        rows = posts.filter(F.pmod(F.xxhash64("id_str"), F.lit(2)) == part)
        tables.append_bucketed(P.hashtag_rows(rows).drop("timestamp"), database, "tb_hashtag", "id_tweet", 8)
        times = rows.select(F.col("id_str").alias("id_tweet"), F.col("created_at").alias("timestamp"))
        tables.append_bucketed(times, database, "times", "id_tweet", 8)
    # The hint only keeps a small table from being broadcast here; large ones are merged anyway.
    return spark.table(f"{database}.tb_hashtag").hint("merge").join(spark.table(f"{database}.times"), "id_tweet")
