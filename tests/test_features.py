import pytest
from pyspark.sql import functions as F

from postwatch.functions import arrays as A
from postwatch.operators import features, vectors


@pytest.fixture
def vector_table(spark):
    words = spark.createDataFrame(
        [(0, "i", [1.0, 0.0]), (1, "love", [0.0, 2.0]), (2, "music", [3.0, 3.0])],
        "place INT, word STRING, vec ARRAY<DOUBLE>",
    )
    return features.with_special_rows(words, ["place"])


def texts(spark, *lines):
    return spark.createDataFrame(list(enumerate(lines)), "id INT, text STRING")


def arrays(df, column="indices"):
    return [r[column] for r in df.orderBy("id").collect()]


def test_special_rows(vector_table):
    rows = {r["word"]: r for r in vector_table.collect()}
    assert {w: r["idx"] for w, r in rows.items()} == {"<EOF>": 0, "i": 1, "love": 2, "music": 3, "<unk>": 4}
    assert rows["<EOF>"]["vec"] == [0.0, 0.0]
    unknown = rows["<unk>"]["vec"]
    assert len(unknown) == 2 and all(0 <= x < 1 for x in unknown) and unknown[0] != unknown[1]
    # The same in every run.
    assert [r for r in vector_table.collect() if r["word"] == "<unk>"][0]["vec"] == unknown


def test_older_numbering(spark):
    words = spark.createDataFrame([(5, "b", [1.0]), (3, "a", [1.0])], "n INT, word STRING, vec ARRAY<DOUBLE>")
    got = {r["word"]: r["idx"] for r in features.without_special_rows(words, ["n"]).collect()}
    assert got == {"a": 0, "b": 1, "<unk>": 2}


@pytest.mark.parametrize("limit", [features.BROADCAST_BYTES, 0])
def test_sentence_to_indices(spark, vector_table, limit):
    df = texts(spark, "i love new music", "", "   ", "music i i")
    index = features.word_index(vector_table)
    got = features.sentence_to_indices(df, ["id"], index, 4, limit=limit)
    assert arrays(got) == [[1, 2, 4, 3], [], [], [3, 1, 1]]


def test_words_are_regrouped_without_a_shuffle(spark, vector_table):
    index = features.word_index(vector_table)
    df = texts(spark, "i love", "").repartition(2)
    for found in (
        features.sentence_to_indices(df, ["id"], index, 4),
        features.sentence_to_matrix(df, ["id"], vector_table, 4, 3),
    ):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        executed = found._jdf.queryExecution().executedPlan().toString()
        # The first lines are the last steps: regrouping stands over the words without an exchange between.
        assert "Generate" in plan and "Exchange hashpartitioning" not in executed[: executed.index("Generate")]


def test_last_place_of_a_repeated_word_counts(spark):
    table = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "word STRING, idx LONG")
    assert sorted(map(tuple, features.word_index(table).collect())) == [("a", 3), ("b", 2)]


@pytest.mark.parametrize("limit", [features.BROADCAST_BYTES, 0])
def test_sentence_to_matrix(spark, vector_table, limit):
    df = texts(spark, "love i", "", "music x love")
    got = arrays(features.sentence_to_matrix(df, ["id"], vector_table, 4, 3, limit=limit), "matrix")
    zero = [0.0, 0.0]
    unknown = vector_table.filter("idx = 4").first()["vec"]
    assert got == [[[0.0, 2.0], [1.0, 0.0], zero], [zero, zero, zero], [[3.0, 3.0], unknown, [0.0, 2.0]]]


def test_pad_and_trim(one):
    ints = "ARRAY<INT>"
    assert one(lambda c: A.pad(c, 4), [1, 2], ints) == [1, 2, 0, 0]
    assert one(lambda c: A.pad(c, 2), [1, 2, 3], ints) == [1, 2, 3]
    assert one(lambda c: A.pad(c, 2), [], ints) == [0, 0]
    assert one(lambda c: A.trim(c, 2), [1, 2, 3], ints) == [1, 2]
    assert one(lambda c: A.trim(c, 5), [1], ints) == [1]


def test_lengths(spark):
    df = texts(spark, "a b c", "", "a\nb c d e f g", None)
    assert tuple(features.max_tokens(df).first()) == (7, 8)
    assert features.padded_length(df.filter("id < 2")) == 4
    assert features.padded_length(df.limit(0)) == 0


def test_longest_text(spark):
    df = texts(spark, "aa", "bbb", "ccc", "")
    assert features.longest_text(df, "id").first()["text"] == "bbb"


def test_vocabulary_order_and_limit(spark):
    df = texts(spark, "Flu, flu! zika", "ebola zika measles")
    got = [(r["word"], r["idx"], r["n"]) for r in features.fit_vocabulary(df).orderBy("idx").collect()]
    assert got == [("flu", 2, 2), ("zika", 3, 2), ("ebola", 4, 1), ("measles", 5, 1)]
    small = features.kept_words(features.fit_vocabulary(df), 4)
    assert [r["word"] for r in small.orderBy("idx").collect()] == ["flu", "zika"]
    got = features.texts_to_sequences(df, ["id"], small)
    assert arrays(got) == [[2, 2, 3], [1, 3, 1]]
    assert arrays(features.binary_bag_of_words(got), "positions") == [[2, 3], [1, 3]]


@pytest.mark.parametrize("limit", [features.BROADCAST_BYTES, 0])
def test_unknown_words(spark, limit):
    df = texts(spark, "a x b y x", "a", "")
    index = spark.createDataFrame([("a", 1), ("b", 2)], "word STRING, idx INT")
    unknown = features.unknown_words(df, "id", index, limit=limit)
    got = sorted(tuple(r) for r in features.unknown_per_text(unknown, df, "id").collect())
    assert got == [(0, "x y x", 3), (1, "", 0), (2, "", 0)]
    assert tuple(features.unknown_totals(unknown).first()) == (3, 2)
    none = features.unknown_words(df.filter("id = 1"), "id", index, limit=limit)
    assert tuple(features.unknown_totals(none).first()) == (0, 0)


@pytest.mark.parametrize("limit", [features.BROADCAST_BYTES, 0])
def test_dimension_and_bridge(spark, limit):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, "b")], "id INT, term STRING")
    dimension = features.term_dimension(rows, "term")
    assert sorted(map(tuple, dimension.collect())) == [(1, "a"), (2, "b")]
    pairs = rows.withColumnRenamed("id", "doc").distinct()
    bridge = features.term_bridge(pairs, "doc", "term", dimension, limit)
    assert sorted(map(tuple, bridge.collect())) == [(1, 1), (1, 2), (2, 2)]


def test_labels(one):
    scores = "ARRAY<DOUBLE>"
    assert one(A.argmax, [0.1, 0.7, 0.7], scores) == 1
    assert [one(A.label_name, i, "INT") for i in (0, 1, 2, 3)] == ["negative", "positive", "neutral", None]
    assert one(lambda c: A.one_hot(c, 3), 1, "INT") == [0, 1, 0]
    assert [one(A.binary_label, i, "INT") for i in (0, 1, 2)] == [0, 1, 0]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "u ARRAY<DOUBLE>, v ARRAY<DOUBLE>")
    a, b = (r["c"] for r in df.select(A.cosine(F.col("u"), F.col("v")).alias("c")).collect())
    assert a == pytest.approx(2 ** -0.5) and b is None


def test_most_similar_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    data = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id INT, vec ARRAY<DOUBLE>")
    queries = df.filter("id < 3").withColumnRenamed("id", "query")
    got = {(r["query"], r["place"]): r["id"] for r in vectors.most_similar(queries, df, "id", "vec", 4).collect()}
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    for q in range(3):
        best = np.argsort(-(unit @ unit[q]), kind="stable")[:4]
        assert [got[(q, p)] for p in range(1, 5)] == list(best)



def test_most_similar_of_many_queries(spark):
    """More queries than a block: each is nearest to its own vector."""
    df = spark.range(300).select("id", F.array(F.cos(F.col("id") / 100), F.sin(F.col("id") / 100)).alias("vec"))
    got = vectors.most_similar(df.withColumnRenamed("id", "query"), df, "id", "vec", 1).collect()
    assert {r["query"]: r["id"] for r in got} == {i: i for i in range(300)}
    assert vectors.most_similar(df.limit(0).withColumnRenamed("id", "query"), df, "id", "vec").count() == 0


def test_sequences_are_made_in_several_tasks(spark):
    """Compact texts are small, what is made of their words is not: their partitions are not joined into one."""
    df = spark.range(200).select(F.col("id").alias("k"), F.lit("a b c").alias("text"))
    index = spark.createDataFrame([("a", 1), ("b", 2)], "word STRING, idx INT")
    got = features.sentence_to_indices(df, ["k"], index, 9).withColumn("part", F.spark_partition_id()).collect()
    assert len({r["part"] for r in got}) > 1 and all(r["indices"] == [1, 2, 9] for r in got) and len(got) == 200
