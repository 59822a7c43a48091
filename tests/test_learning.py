import pytest
from pyspark.ml.functions import array_to_vector

from postwatch.plans import classify


@pytest.fixture
def toy(spark):
    # Four sentences in two classes, as often as it takes to learn from them.
    lines = [("flu is bad", 1), ("zika is all over the place", 1), ("soccer is slow", 0), ("world cup rum booze", 0)]
    return spark.createDataFrame([(t, y) for t, y in lines * 5], "text STRING, label INT")


def test_text_classifier(spark, toy, tmp_path):
    model = classify.fit(toy, classify.binary_regression(maxIter=50), classify.text_stages(50))
    assert classify.report(classify.judged(model.transform(toy))).first()["accuracy"] == 1.0
    new = spark.createDataFrame([("the Flu, all over!",), ("slow rum",), ("",)], "text STRING")
    got = [(r["text"], r["sentiment"]) for r in classify.score_new(model, new).collect()]
    assert got[:2] == [("the Flu, all over!", "positive"), ("slow rum", "negative")] and len(got) == 3
    model.save(str(tmp_path / "m"))
    assert classify.evaluate_saved(str(tmp_path / "m"), toy).first()["f1"] == 1.0


def test_tokenizer_stage_is_the_tokenizer_function(spark):
    from postwatch.functions import text as X

    df = spark.createDataFrame([("Don't [stop]--NOW\\t^_`{please}~\n\"ok\" a-b",), ("",), ("...",)], "text STRING")
    stage = classify.text_stages()[0]
    rows = stage.transform(df.withColumn("expected", X.tokenizer_words(df["text"]))).collect()
    assert all(r["words"] == r["expected"] for r in rows)


def test_class_weights_go_along(toy):
    weights = {r["label"]: r["weight"] for r in classify.weighted(toy.filter("text != 'soccer is slow'")).collect()}
    assert weights == {1: pytest.approx(15 / 20), 0: pytest.approx(15 / 10)}


def test_sweep_has_a_row_per_run(spark, tmp_path):
    df = spark.createDataFrame([(i % 2, [float(i % 2), 0.1 * i]) for i in range(20)], "label INT, v ARRAY<DOUBLE>")
    df = classify.weighted(df.select("label", array_to_vector("v").alias("features")))
    settings = classify.grid({"regParam": [0.0, 0.1], "maxIter": [5]})
    found = classify.sweep(df, df, classify.softmax_regression(), settings, models=str(tmp_path))
    runs = found.collect()
    assert {(r["regParam"], r["maxIter"]) for r in runs} == {(0.0, 5), (0.1, 5)} and all(r["seconds"] > 0 for r in runs)
    best = classify.best_model(found, str(tmp_path))
    assert classify.report(classify.judged(best.transform(df))).first()["accuracy"] == 1.0
    assert sorted(r["run"] for r in runs) == ["regParam=0.0,maxIter=5", "regParam=0.1,maxIter=5"]
    assert all(r["accuracy"] == 1.0 for r in runs)


def test_cross_validation_finds_the_better_setting(spark):
    df = spark.createDataFrame([(i, i % 2, [float(i % 2), 0.1 * (i % 7)]) for i in range(60)], "k LONG, label INT, v ARRAY<DOUBLE>")
    df = classify.weighted(df.select("k", "label", array_to_vector("v").alias("features")))
    settings = classify.grid({"regParam": [0.0, 0.01], "maxIter": [0, 20]})
    runs, best = classify.cross_validated(df, "k", classify.softmax_regression(), settings)
    found = {r["run"]: r["f1"] for r in runs.collect()}
    assert found["regParam=0.0,maxIter=20"] == 1.0 > found["regParam=0.0,maxIter=0"]
    assert classify.report(classify.judged(best.transform(df))).first()["accuracy"] == 1.0


def test_run_log_appends(spark, tmp_path):
    reports = spark.createDataFrame([("r", 0.5)], "run STRING, f1 DOUBLE")
    for _ in range(2):
        classify.log_runs(reports, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2


def test_prepare(spark):
    vectors = spark.createDataFrame([("<EOF>", 0), ("a", 1), ("b", 2), ("<unk>", 3)], "word STRING, idx LONG")
    df = spark.createDataFrame([(i, "a b c" if i % 2 else "", i % 2) for i in range(10)], "k LONG, text STRING, label INT")
    rows, length = classify.prepare(df, "k", vectors, 3)
    assert length == 4
    got = {r["k"]: (r["indices"], r["split"]) for r in rows.collect()}
    assert got[0] == ([0, 0, 0, 0], "test") and got[3] == ([1, 2, 3, 0], "valid") and got[9][1] == "train"


def test_gaussian_stats(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [3.0]), (1, [5.0])], "label INT, v ARRAY<DOUBLE>")
    got = sorted(map(tuple, classify.gaussian_stats(df, "label", "v").collect()))
    assert got == [(0, 0, 2, 2.0, 1.0), (1, 0, 1, 5.0, 0.0)]


def test_a_run_without_the_class_is_reported(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 0, 2), ("b", 1, 1)], "run STRING, y_true INT, y_pred INT")
    got = {r["run"]: (r["accuracy"], r["recall"], r["specificity"]) for r in classify.report(df, by=["run"]).collect()}
    assert got == {"a": (0.5, None, 1.0), "b": (1.0, 1.0, None)}
