from pyspark.sql import functions as F

from postwatch.functions.words import TERMS
from postwatch.operators import lookup
from postwatch.operators import posts as P


def ids(df, column="id_str"):
    return sorted(r[column] for r in df.collect())


def test_drop_retweets(posts, post):
    # No mark means no retweet.
    df = posts(post("1"), post("2", retweeted=True), post("3", status="9"), post("4", retweeted=None))
    assert ids(P.drop_retweets(df)) == ["1", "4"]


def test_extended_text(posts, post):
    assert ids(P.with_extended_text(posts(post("1"), post("2", extended=False)))) == ["1"]


def test_tracked(posts, post):
    df = posts(post("1", "the FLU"), post("2", "flu", lang="fr"), post("3", "well"))
    assert ids(P.tracked(df, TERMS)) == ["1"]


def test_flat_posts(posts, post):
    row = P.flat_posts(posts(post("1", "hello"))).first()
    assert (row["twitter_id"], row["user_twitter_id"], row["full_text"]) == ("1", "7", "hello")
    assert row["is_reply"] is False and row["is_decomposed"] is False and row["used_tweet"] == ""


def test_tagging_stores_the_altered_text(posts, post):
    df = posts(post("1", "Zika,#flu. flu"), post("2", "fluid"))
    got = sorted((r["disease"], r["tweet"]) for r in P.tagged_posts(df, TERMS).collect())
    assert got == [("flu", "Zika  flu  flu"), ("zika", "Zika  flu  flu")]
    by_union = sorted((r["disease"], r["tweet"]) for r in P.tagged_posts_by_union(df, TERMS).collect())
    assert by_union == got


def test_hashtags(posts, post):
    df = posts(post("1", hashtags=["a", "b", "a"]), post("2"), post("3", extended=False))
    assert sorted(r["hashtag"] for r in P.hashtag_rows(df).collect()) == ["a", "a", "b"]


def test_join_form_is_the_carried_form_for_unique_ids(posts, post):
    df = posts(post("1", hashtags=["a"]), post("2", hashtags=["b", "c"]))
    carried = P.hashtag_rows(df)
    joined = P.join_times(carried.drop("timestamp"), df)
    columns = ["id_tweet", "hashtag", "timestamp"]
    assert sorted(joined.select(columns).collect()) == sorted(carried.select(columns).collect())


def test_join_multiplies_rows_of_a_repeated_id(posts, post):
    df = posts(post("1", hashtags=["a", "b"]), post("1", hashtags=["a", "b"]))
    assert P.join_times(P.hashtag_rows(df).drop("timestamp"), df).count() == 8


def test_keyword_rows(posts, post, stop_words):
    rows = P.keyword_rows(posts(post("1", "Flu and flu"), post("2", "")), stop_words).collect()
    assert [(r["id_tweet"], r["keyword"]) for r in rows] == [("1", "flu"), ("1", "flu")]


def test_stop_word_table(spark):
    words = spark.createDataFrame([("THE",), ("FLU",), ("The",)], "word STRING")
    stops = spark.createDataFrame([("THE",), ("THE",)], "word STRING")
    for limit in (lookup.BROADCAST_BYTES, 0):
        assert ids(P.without_stop_words(words, stops, limit=limit), "word") == ["FLU", "The"]


def places(spark):
    return lookup.best_places(spark.createDataFrame(
        [("San Juan", "pr", 2.0), ("san  juan", "ar", 1.0), ("Paris", "us", 1.0), ("Paris", "fr", 1.0)],
        "place STRING, country_code STRING, rank DOUBLE",
    ))


def test_locations(spark, posts, post):
    df = P.user_rows(posts(
        post("1", location=" SAN juan! "), post("2", location="Paris"), post("3", location="nowhere"),
        post("4"), post("5", location=""),
    ))
    want = [("1", "ar"), ("2", "fr"), ("3", None), ("4", None), ("5", None)]
    for limit in (lookup.BROADCAST_BYTES, 0):
        rows = lookup.enrich_location(df, places(spark), limit)
        assert rows.columns == df.columns
        assert sorted((r["id_tweet"], r["location"]) for r in rows.collect()) == want


def test_salted_lookup_is_the_broadcast_lookup(spark):
    # A third of the rows share one key, others have none or an unknown one.
    rows = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), "id"))
        .alias("word"),
    )
    dictionary = spark.createDataFrame([("hot", 1), ("k1", 2), ("k4", 3)], "word STRING, idx INT")
    for how in ("left", "inner"):
        a = lookup.lookup_join(rows, dictionary, "word", ["id"], how)
        b = lookup.lookup_join(rows, dictionary, "word", ["id"], how, limit=0)
        assert a.columns == b.columns
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_small_dictionaries_are_broadcast_and_large_ones_salted(spark):
    from tests.test_catalog import explained

    rows = spark.range(10).select("id", F.col("id").cast("string").alias("word"))
    dictionary = rows.select("word", F.col("id").alias("idx"))
    assert "BroadcastHashJoin" in explained(lookup.lookup_join(rows, dictionary, "word", ["id"]))
    salted = explained(lookup.lookup_join(rows, dictionary, "word", ["id"], limit=0))
    assert "_salt" in salted


def test_measured_bytes_grow_with_the_rows(spark):
    small = spark.range(10).select(F.col("id"), F.lit("abc").alias("w"))
    large = spark.range(1000).select(F.col("id"), F.lit("abc").alias("w"))
    assert lookup.measured_bytes(large) == 100 * lookup.measured_bytes(small) > 0
    assert lookup.measured_bytes(small.limit(0)) == 0
