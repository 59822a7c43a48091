"""Steps that are stored once and read by several passes."""

from postwatch.catalog import learning, sources
from postwatch.plans import classify, store
from postwatch.sources import tables


def test_no_padding_is_shuffled(spark):
    labeled = spark.createDataFrame([(i, "a b" if i else "a " * 30, i % 2) for i in range(6)], "k long, text string, label int")
    vectors = spark.createDataFrame([(0, "<EOF>"), (1, "a"), (2, "b"), (3, "<unk>")], "idx int, word string")
    rows, length = classify.prepare(labeled, "k", vectors, 3)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # The padding stands above the join.
    assert plan.index("array_repeat") < plan.index("Join")
    assert length == 30 and {len(r["indices"]) for r in rows.collect()} == {30} and rows.count() == 6


def table_reads(monkeypatch, module):
    kept = []
    keep = module.keep
    monkeypatch.setattr(module, "keep", lambda df, name: kept.append(name) or keep(df, name))
    return kept


def folder(spark, tmp_path):
    docs = [(i, f"Zeitung that der with words {i % 5} und Morgen", "en", "web", 40) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, [float(i), 1.0], i % 3) for i in range(9)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.sql("SELECT id AS event_id, TIMESTAMP_NTZ'2024-01-02 03:00:00' + make_dt_interval(0, int(id)) AS ts, id % 3 AS user_id, 'click2' AS event_type, 1.0D AS value, '{\"k\": 3}' AS props FROM range(30)").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_labelled_texts_are_stored_once(spark, tmp_path, monkeypatch):
    kept = table_reads(monkeypatch, learning)
    assert learning.text_pipeline(spark, folder(spark, tmp_path)).count() == 1
    assert {"labeled", "train", "valid"} <= set(kept)


def test_posts_are_joined_once_for_both_runs(spark, tmp_path, monkeypatch):
    kept, seen = table_reads(monkeypatch, sources), []
    update = store.update_store
    monkeypatch.setattr(store, "update_store", lambda counted, path: seen.append(
        counted["keywords"]._jdf.queryExecution().optimizedPlan().toString()) or update(counted, path))
    found = sources.store_backfill(spark, folder(spark, tmp_path))
    assert found.filter("store = 'disease' AND item = 'that'").agg({"mentions": "sum"}).first()[0] == 30
    assert kept[:2] == ["own", "tb_tweet"] and len(seen) == 2 and not any("Join" in p for p in seen)


def test_no_padding_is_sorted(spark, tmp_path):
    labeled = spark.createDataFrame([(i, "a " * (i + 1), i % 2) for i in range(9)], "k long, text string, label int")
    vectors = spark.createDataFrame([(0, "<EOF>"), (1, "a"), (2, "<unk>")], "idx int, word string")
    rows, length = classify.prepare(labeled, "k", vectors, 2)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # The order in which splits are written stands below the padding.
    assert plan.index("array_repeat") < plan.index("Sort [split")
    tables.write_splits(rows, str(tmp_path / "s"))
    got = {r["k"]: r["indices"] for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert length == 10 and got == {i: [1] * (i + 1) + [0] * (9 - i) for i in range(9)}


def test_longer_texts_are_cut_and_shorter_ones_padded(spark):
    texts = spark.createDataFrame([(1, "a b a b"), (2, "a"), (3, ""), (4, None), (5, "b b b")], "k long, text string")
    index = spark.createDataFrame([("a", 1), ("b", 2)], "word string, idx int")
    got = {r["k"]: r["indices"] for r in classify.padded_indices(texts, ["k"], index, 3, 3).collect()}
    assert got == {1: [1, 2, 1], 2: [1, 0, 0], 3: [0, 0, 0], 4: [0, 0, 0], 5: [2, 2, 2]}
