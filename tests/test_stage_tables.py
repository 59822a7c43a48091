"""Tables that stages and lookups copy: no more than they can meet."""

from pyspark.sql import functions as F

from postwatch.plans import stages


def test_vectors_that_no_index_reaches_are_not_stored(spark):
    vectors = spark.range(2, 50).select(F.col("id").cast("int").alias("idx"), F.array(F.lit(1.0)).alias("vec"))
    table = stages.text_pipeline(["k"], 4, num_words=6, vectors=vectors)[-1].table
    assert sorted(r["idx"] for r in table.collect()) == [2, 3, 4, 5]
