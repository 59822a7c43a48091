"""Shards come shuffled, and alike in every run."""

from pyspark.sql import functions as F

from postwatch.llm import mixing


def test_shards_are_shuffled_and_whole(spark):
    docs = spark.range(600).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b c"), "id").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.lit(1).alias("shard")
    )
    out = mixing.mix(docs, block_words=50)
    assert out.columns == [*docs.columns, "pass", "shard_", "place"]
    rows = out.withColumn("part", F.spark_partition_id()).collect()
    parts, order = {}, {}
    for r in rows:
        parts.setdefault(r["shard_"], set()).add(r["part"])
        order.setdefault(r["shard_"], []).append((r["place"], r["doc_id"]))
    assert all(len(p) == 1 for p in parts.values()) and len(parts) > 10
    assert all(o == sorted(o) for o in order.values())
    # A shuffle, not the order of the documents.
    assert sum([d for _, d in o] != sorted(d for _, d in o) for o in order.values()) > len(order) / 2
    again = [(r["shard_"], r["place"], r["doc_id"]) for r in mixing.mix(docs.repartition(5), block_words=50).collect()]
    assert sorted(again) == sorted((r["shard_"], r["place"], r["doc_id"]) for r in rows)
