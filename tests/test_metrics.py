import pytest
from pyspark.sql import functions as F

from postwatch.operators import metrics
from postwatch.plans import classify


def judged(spark, y, p):
    return spark.createDataFrame(list(zip(y, p)), "y_true INT, y_pred INT")


def test_binary(spark):
    row = metrics.binary_metrics(judged(spark, [1, 1, 0, 0], [1, 0, 1, 0])).first()
    for name in ("precision", "recall", "f1", "fprate"):
        assert row[name] == pytest.approx(0.5, abs=1e-6)


def test_no_positives(spark):
    row = metrics.binary_metrics(judged(spark, [0, 0], [1, 0])).first()
    assert row["recall"] is None and row["f1"] is None and row["fprate"] == pytest.approx(0.5, abs=1e-6)


def test_scores_round_half_to_even(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 1.5), (0, 0.4)], "y_true INT, y_pred DOUBLE")
    # 0.5 rounds to 0 and 1.5 to 2.
    assert metrics.binary_metrics(df).first()["precision"] == pytest.approx(1.0, abs=1e-6)
    assert metrics.binary_metrics(df).first()["recall"] == pytest.approx(1.0)


def test_micro(spark):
    df = spark.createDataFrame([([1, 0, 0], [0.9, 0.1, 0.6]), ([0, 1, 0], [0.7, 0.2, 0.1])], "y ARRAY<INT>, s ARRAY<DOUBLE>")
    row = metrics.micro_metrics(df, "y", "s").first()
    assert row["precision"] == pytest.approx(1 / 3, abs=1e-6) and row["recall"] == pytest.approx(0.5)


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (1,), (2,)], "label INT")
    got = {r["label"]: r["weight"] for r in metrics.class_weights(df).collect()}
    assert got == {0: pytest.approx(4 / 6), 1: pytest.approx(4 / 3), 2: pytest.approx(4 / 3)}


def test_per_class_against_the_matrix(spark):
    m = [[5, 1, 2], [0, 7, 3], [4, 0, 6]]
    df = spark.createDataFrame(
        [(i, j, m[i][j]) for i in range(3) for j in range(3) if m[i][j]], "y_true INT, y_pred INT, n LONG")
    total = sum(map(sum, m))
    rows = {r["label"]: r for r in metrics.per_class_metrics(df).collect()}
    for k in range(3):
        tp, actual, found = m[k][k], sum(m[k]), sum(r[k] for r in m)
        p, r = tp / found, tp / actual
        tn = total - actual - found + tp
        got = rows[k]
        assert got["accuracy"] == pytest.approx(18 / total)
        assert (got["precision"], got["recall"]) == (pytest.approx(p), pytest.approx(r))
        assert got["f1"] == pytest.approx(2 * p * r / (p + r))
        assert got["specificity"] == pytest.approx(tn / (total - actual))


def test_a_class_never_predicted(spark):
    rows = {r["label"]: r for r in metrics.per_class_metrics(
        metrics.confusion_matrix(judged(spark, [0, 1], [0, 0]))).collect()}
    assert rows[1]["precision"] is None and rows[1]["recall"] == 0 and rows[1]["f1"] is None


def test_dense_matrix(spark):
    dense = metrics.dense_matrix(metrics.confusion_matrix(judged(spark, [0, 1, 1], [1, 1, 1])), [0, 1, 2])
    assert sorted(map(tuple, dense.collect())) == [(0, 0, 1, 0), (1, 0, 2, 0), (2, 0, 0, 0)]


def test_leaderboard_keeps_the_best(spark):
    runs = [(f"r{i:02d}", i / 20, i / 20, i / 20) for i in range(12)] + [("none", 0.9, 0.0, None)]
    df = spark.createDataFrame(runs, "run STRING, f1 DOUBLE, recall DOUBLE, precision DOUBLE")
    assert [r["run"] for r in metrics.leaderboard(df).collect()] == [f"r{i:02d}" for i in range(11, 3, -1)]


def test_grid_sizes():
    assert len(classify.grid(classify.CNN_GRID)) == 1080
    assert len(classify.grid(classify.RNN_GRID)) == 1120
    assert len(classify.grid(classify.LR_GRID)) == 140


def test_run_plan(spark):
    df = spark.createDataFrame([(0,), (0,), (1,)], "label INT")
    plan = classify.run_plan(df, "label", {"a": [1, 2], "b": ["x", "y", "z"]})
    assert plan.count() == 12 and plan.select("a", "b").distinct().count() == 6


def test_report(spark):
    df = judged(spark, [1, 1, 0, 2], [1, 0, 0, 2]).withColumn("run", F.lit("r"))
    row = classify.report(df, by=["run"]).first()
    assert (row["accuracy"], row["precision"], row["recall"]) == (0.75, 1.0, 0.5)
