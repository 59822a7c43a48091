"""Only the dictionary rows of hot keys are copied."""

from pyspark.sql import functions as F

from postwatch.operators import lookup


def given(spark):
    word = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id")))
    rows = spark.range(20_000).select("id", word.alias("word"))
    known = F.when(F.col("id") == 0, "hot").when(F.col("id") == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id")))
    return rows, spark.range(6000).select(known.alias("word"), F.col("id").alias("idx"))


def test_a_dictionary_is_copied_for_hot_keys_only(spark):
    rows, dictionary = given(spark)
    joined = lookup.lookup_join(rows, dictionary, "word", ["id"], "left", limit=0)
    # Dictionary rows that are sent to the join: one each, and those of the hot key once per salt.
    salted, copies = lookup._salted(rows, dictionary, "word", ["id"])
    assert copies.count() == 6000 + lookup.SALTS - 1
    spread = {r["word"]: r["n"] for r in salted.groupBy("word").agg(F.count_distinct("_salt").alias("n")).filter("n > 1").collect()}
    assert spread == {"hot": lookup.SALTS, None: lookup.SALTS}
    want = rows.join(F.broadcast(dictionary), "word", "left")
    assert joined.columns == want.columns
    assert sorted(map(str, joined.collect())) == sorted(map(str, want.collect()))


def test_anti_join_with_a_shuffled_dictionary(spark):
    rows, dictionary = given(spark)
    got = lookup.lookup_join(rows, dictionary.select("word"), "word", ["id"], "left_anti", limit=0)
    want = rows.join(F.broadcast(dictionary), "word", "left_anti")
    assert got.columns == rows.columns or got.columns == want.columns
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect())
