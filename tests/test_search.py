"""Nearest vectors, large term lists, the gazetteer and tables in buckets."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from postwatch.operators import lookup, terms, vectors
from postwatch.sources import tables


def points(spark, n=600, seed=1, width=8):
    """Clustered points, copies and a zero vector among them."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 3, (12, width))
    x = centres[rng.integers(0, 12, n)] + rng.normal(0, 1, (n, width))
    x[5], x[6], x[9] = x[4], x[4] * 2, 0
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")


def nearest(x, i, k):
    with np.errstate(divide="ignore", invalid="ignore"):
        unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        found = np.round(unit @ unit[i], vectors.DIGITS)
    order = sorted(range(len(x)), key=lambda j: (np.isnan(found[j]), -found[j] if not np.isnan(found[j]) else 0, j))
    return order[:k]


def test_exact_search_in_many_cells(spark):
    x, df = points(spark)
    queries = df.filter("id % 7 = 2 or id = 9").withColumnRenamed("id", "query")
    for cells in ((20_000, 5_000), (37, 10)):
        got = vectors.most_similar(queries, df, "id", "vec", 6, *cells).collect()
        found = {}
        for r in sorted(got, key=lambda r: r["place"]):
            found.setdefault(r["query"], []).append(r["id"])
        assert set(found) == {i for i in range(600) if i % 7 == 2 or i == 9}
        for q, ids in found.items():
            assert ids == nearest(x, q, 6), q
    assert all(r["cosine"] is None for r in got if r["query"] == 9)


@pytest.mark.parametrize("cell_vectors, cell_queries", [(20_000, 5_000), (30, 20)])
def test_recall_of_the_index(spark, cell_vectors, cell_queries):
    x, df = points(spark, 3000)
    queries = df.filter("id % 50 = 0").withColumnRenamed("id", "query")
    index = vectors.build_index(df, "id", "vec", per_cell=100, cell_vectors=cell_vectors)
    assert index.cells.count() == 3000
    got = vectors.search_index(index, queries, "vec", k=10, probes=8, cell_queries=cell_queries).collect()
    assert len({(r["query"], r["id"]) for r in got}) == len(got)
    hits = sum(r["id"] in nearest(x, r["query"], 10) for r in got)
    assert hits / (60 * 10) >= 0.9
    # With all cells probed the index is exact.
    every = vectors.search_index(index, queries, "vec", k=10, probes=1000).collect()
    assert {(r["query"], r["id"], r["place"]) for r in every if r["query"] != 9} == {
        (q, i, p + 1) for q in range(0, 3000, 50) for p, i in enumerate(nearest(x, q, 10))}


def test_recall_on_the_stored_vectors(spark):
    from postwatch.catalog import QUERIES

    sf = "/root/testdata/sf0.01"
    exact = {(r["query"], r["vec_id"]) for r in QUERIES["cosine_topk_many"](spark, sf).collect()}
    found = {(r["query"], r["vec_id"]) for r in QUERIES["cosine_index"](spark, sf).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_search_of_nothing(spark):
    _, df = points(spark, 40)
    none = df.limit(0)
    assert vectors.most_similar(none.withColumnRenamed("id", "query"), df, "id", "vec").count() == 0
    assert vectors.most_similar(df.withColumnRenamed("id", "query"), none, "id", "vec").count() == 0
    index = vectors.build_index(none, "id", "vec")
    assert vectors.search_index(index, df.withColumnRenamed("id", "query"), "vec").count() == 0


@pytest.fixture
def posts(spark):
    rows = [(1, "New York, new york city!"), (2, "flu in #New York"), (3, ""), (4, None), (5, "new yorker york"), (6, "a b a b a")]
    return spark.createDataFrame(rows, "k int, text string")


def test_terms_of_several_words(spark, posts):
    listed = [("New York",), ("new york  city!",), ("flu",), ("a b a",), ("York",), ("new",), ("",), (None,), ("FLU",)]
    trie = terms.term_trie(spark.createDataFrame(listed, "term string"))
    for limit in (1 << 30, 0):
        got = sorted(map(tuple, terms.term_hits(posts, ["k"], trie, limit=limit).collect()))
        assert got == sorted([
            (1, 0, "New York"), (1, 0, "new"), (1, 1, "York"), (1, 2, "New York"), (1, 2, "new york  city!"), (1, 2, "new"), (1, 3, "York"),
            (2, 0, "FLU"), (2, 2, "New York"), (2, 2, "new"), (2, 3, "York"), (5, 0, "new"), (5, 2, "York"), (6, 0, "a b a"), (6, 2, "a b a")])
    assert sorted(r["k"] for r in terms.having_terms(posts, ["k"], trie).collect()) == [1, 2, 5, 6]
    assert terms.with_terms(posts, ["k"], trie).filter("k = 6").collect() == [(6, "a b a")]
    none = terms.term_trie(spark.createDataFrame([], "term string"))
    assert terms.term_hits(posts, ["k"], none).collect() == []


def test_ten_thousand_terms_are_no_expressions(spark, posts):
    rng = random.Random(0)
    listed = {" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(1, 6))) for _ in range(24_000)}
    assert len(listed) > 10_000
    trie = terms.term_trie(spark.createDataFrame([(t,) for t in listed], "term string"))
    found = terms.term_hits(posts, ["k"], trie)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 40_000
    words = {r["k"]: (r["text"] or "").lower().replace("#", " ").replace(",", " ").replace(".", " ").split() for r in posts.collect()}
    want = {(k, i, " ".join(w[i:j])) for k, w in words.items() for i in range(len(w)) for j in range(i + 1, len(w) + 1) if " ".join(w[i:j]) in listed}
    assert {tuple(r) for r in found.collect()} == want


def test_gazetteer(spark):
    known = [("Paris", "fr", 1), ("Paris, Texas", "us", 1), ("Texas", "us", 2), ("France", "fr", 1), ("New York", "us", 1), ("paris", "xx", 9)]
    places = lookup.best_places(spark.createDataFrame(known, "place string, country_code string, rank int"))
    rows = [(1, "Paris"), (2, "paris,  TEXAS!"), (3, "Nowhere, France"), (4, "Paris, Nowhere"), (5, "Nowhere"), (6, None), (7, " , ,"),
            (8, "Mars, New York, Moon"), (9, "10th, New York, USA, Texas")]
    users = spark.createDataFrame(rows, "k int, location string")
    for limit in (1 << 30, 0):
        got = {r["k"]: tuple(r)[1:] for r in lookup.locate(users, ["k"], places, limit=limit).collect()}
        assert got == {
            1: ("fr", "paris", 1), 2: ("us", "paris texas", 1), 3: ("fr", "france", 2), 4: ("fr", "paris", 3), 5: (None, None, None),
            6: (None, None, None), 7: (None, None, None), 8: (None, None, None), 9: ("us", "texas", 4)}


def test_tables_in_buckets_are_joined_without_a_shuffle(spark):
    database = f"test_{uuid.uuid4().hex}"
    left, right = spark.range(1000).select((F.col("id") % 300).alias("k"), "id"), spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for part in (0, 1):
        tables.append_bucketed(left.filter(F.col("id") % 2 == part), database, "a", "k", 4)
        tables.append_bucketed(right.filter(F.col("v") % 4 == 2 * part), database, "b", "k", 4)
    joined = spark.table(f"{database}.a").hint("merge").join(spark.table(f"{database}.b"), "k")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    want = {(i % 300, i, i % 300 * 2) for i in range(1000) if i % 300 < 200}
    assert {tuple(r) for r in joined.collect()} == want
    grouped = spark.table(f"{database}.a").groupBy("k").count()
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
    spark.sql(f"DROP DATABASE {database} CASCADE")


def test_the_bucketed_query_has_no_shuffle(spark):
    from postwatch.catalog import QUERIES

    found = QUERIES["bucketed_join"](spark, "/root/testdata/sf0.001")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
