"""Small cells copy neither side more and more often as tables grow."""


from postwatch.operators import vectors
from tests.test_search import nearest, points


def test_copies_do_not_grow_with_the_queries(spark, monkeypatch):
    seen = {}
    search = vectors._search

    def watched(left, right, key, k):
        seen.update(left=left.count(), right=right.count())
        return search(left, right, key, k)

    monkeypatch.setattr(vectors, "_search", watched)
    x, df = points(spark)
    queries = df.filter("id % 2 = 0").withColumnRenamed("id", "query")
    got = vectors.most_similar(queries, df, "id", "vec", 4, cell_vectors=20, cell_queries=5).collect()
    n = df.filter("vec IS NOT NULL").count()
    assert seen["right"] <= vectors.COPIES * n and seen["left"] <= vectors.COPIES * queries.count()
    found = {}
    for r in sorted(got, key=lambda r: r["place"]):
        found.setdefault(r["query"], []).append(r["id"])
    assert all(ids == nearest(x, q, 4) for q, ids in found.items()) and len(found) == queries.filter("vec IS NOT NULL").count()


def test_large_cells_are_kept_small_enough():
    assert vectors._dealt(1_000_000, 8, 50_000) == 20
    assert vectors._dealt(30, 8, 50_000) == 4 and vectors._dealt(9, 8, 50_000) == 2 and vectors._dealt(0, 8, 50_000) == 1
    assert vectors._dealt(1_000_000, 100_000, 50_000) == 10
