"""Stored pipelines, kernel features, moments on streams, scoring on streams."""

import json
import math
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from postwatch.plans import classify, moments, stages
from postwatch.sources import transaction


def ring(spark, n=400, seed=5):
    """Class 1 lies around class 0, class 2 around both."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = i % 3
        r, a = 2.0 * y + rng.uniform(0, 0.8), rng.uniform(0, 2 * math.pi)
        rows.append((i, y, [r * math.cos(a), r * math.sin(a)]))
    return spark.createDataFrame(rows, "key long, label int, values array<double>")


def accuracy(model, rows):
    return classify.report(classify.judged(model.transform(rows))).first()["accuracy"]


def test_kernel_splits_rings_that_a_line_does_not(spark, tmp_path):
    train, test = ring(spark), ring(spark, 150, seed=6)
    *mapped, svc = stages.rbf_classifier(2, gamma=1.0, size=64, maxIter=8, regParam=0.001)
    model = classify.fit(train, svc, mapped)
    assert accuracy(model, test) > 0.95
    straight = [stages.RandomFeatures(inputCol="values", outputCol="unused", width=2, gamma=1.0, size=2, seed=1)]
    plain = train.withColumn("features", stages.array_to_vector("values"))
    line = classify.fit(plain, stages.OneVsRest(classifier=classify.linear_svc(maxIter=5), featuresCol="features"), straight)
    assert accuracy(line, test.withColumn("features", stages.array_to_vector("values"))) < 0.7
    model.save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    assert [r["prediction"] for r in loaded.transform(test).orderBy("key").collect()] == [
        r["prediction"] for r in model.transform(test).orderBy("key").collect()]


def test_kernel_estimates(spark):
    """The mean squared error is at most 1 / size; single errors of four times its root are next to impossible."""
    size, rng = 1024, np.random.default_rng(2)
    points = rng.normal(0, 1, (40, 3))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "i int, v array<double>")
    stage = stages.RandomFeatures(inputCol="v", outputCol="f", width=3, gamma=0.4, size=size, seed=11)
    got = np.array([r["f"] for r in stage.transform(df).select("i", vector_to_array("f").alias("f")).orderBy("i").collect()])
    kernel = np.exp(-0.4 * ((points[:, None] - points[None]) ** 2).sum(axis=2))
    error = got @ got.T - kernel
    assert abs(error).max() < 4 / math.sqrt(size) and (error**2).mean() < 1 / size


@pytest.fixture
def texts(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate([("The flu isn't over! http://x", 1), ("soccer is slow", 0), ("Zika & the flu", 1), ("rum rum booze", 0), ("", 0)] * 4)]
    return spark.createDataFrame(rows, "k long, text string, label int")


def words(spark):
    return spark.createDataFrame([(i, [float(i), 1.0 / i]) for i in range(2, 9)], "idx int, vec array<double>")


LOAD = """
import json, sys
from postwatch.session import local_session
from pyspark.ml import PipelineModel
spark = local_session("2")
rows = spark.read.parquet(sys.argv[2])
out = PipelineModel.load(sys.argv[1]).transform(rows).select("k", "padded", "prediction").orderBy("k").collect()
print("FOUND" + json.dumps([[r["k"], r["padded"], r["prediction"]] for r in out]))
"""


@pytest.mark.parametrize("averaged", [False, True])
def test_a_loaded_pipeline_maps_and_predicts_as_the_stored_one(spark, texts, tmp_path, averaged):
    steps = stages.text_pipeline(["k"], 6, num_words=8, vectors=words(spark) if averaged else None)
    model = classify.fit(texts, classify.binary_regression(maxIter=10), steps)
    model.save(str(tmp_path / "m"))
    new = spark.createDataFrame([(1, "the FLU is, over?", 0), (2, "", 0), (3, "never seen words at all in here", 0), (4, None, 0)], "k long, text string, label int")
    columns = ["k", "padded", "prediction"]
    want = [list(r) for r in model.transform(new).select(*columns).orderBy("k").collect()]
    here = PipelineModel.load(str(tmp_path / "m")).transform(new).select(*columns).orderBy("k").collect()
    assert [list(r) for r in here] == want and all(len(r[1]) == 6 for r in want)
    if averaged:
        # In a new session, whose vocabulary can only come from the folder.
        new.write.parquet(str(tmp_path / "new"))
        env = {**os.environ, "PYTHONPATH": os.getcwd()}
        ran = subprocess.run([sys.executable, "-c", LOAD, str(tmp_path / "m"), str(tmp_path / "new")], capture_output=True, text=True, env=env, check=True)
        found = next(line for line in ran.stdout.splitlines() if line.startswith("FOUND"))
        assert json.loads(found[5:]) == want


def test_vector_average(spark):
    df = spark.createDataFrame([(1, [2, 4, 0]), (2, [0, 0, 0]), (3, [])], "k long, padded array<int>")
    stage = stages.VectorAverage(inputCol="padded", outputCol="features", key=["k"], length=3)
    stage.table = words(spark)
    got = {r["k"]: r["features"].toArray().tolist() for r in stage.transform(df).collect()}
    assert got == {1: [3.0, (1 / 2 + 1 / 4) / 2], 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_moments_of_batches_are_those_of_all_rows(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(3), [rng.gauss(1e6, 1.0), rng.gauss(0, 1)]) for _ in range(90)]
    df = spark.createDataFrame(rows, "label int, vec array<double>")
    folder = str(tmp_path / "m")
    batches = [spark.createDataFrame(rows[i::4], df.schema) for i in range(4)]
    for i in (3, 0, 3, 1):
        moments.add(batches[i], folder, f"b{i}")
    assert moments.compact(spark, folder) == 3
    assert not moments.add(batches[0], folder, "b0")
    moments.add(batches[2], folder, "b2")
    got = {(r["label"], r["pos"]): (r["n"], r["mean"], r["variance"]) for r in moments.read(spark, folder).collect()}
    for r in classify.gaussian_stats(df, "label", "vec").collect():
        n, mean, variance = got.pop((r["label"], r["pos"]))
        assert n == r["n"] and mean == pytest.approx(r["mean"], rel=1e-12) and variance == pytest.approx(r["variance"], rel=1e-6)
    assert not got
    assert len(transaction.visible(folder)) == 2


def test_moments_predict_like_the_model(spark):
    df = ring(spark, 90).withColumn("features", stages.array_to_vector("values"))
    stats = moments.merge(moments.moments(df, "label", "values")).select("label", "pos", "n", "mean", (F.col("squares") / F.col("n")).alias("variance"))
    got = {r["key"]: r["prediction"] for r in moments.predict(df, stats, "key", "values").collect()}
    model = classify.fit(df, classify.gaussian_bayes())
    assert got == {r["key"]: int(r["prediction"]) for r in model.transform(df).collect()}


def test_a_stream_is_scored_like_a_table(spark, texts, tmp_path):
    for steps in (classify.text_stages(50), stages.text_pipeline(["k"], 6, num_words=50)):
        model = classify.fit(texts, classify.binary_regression(maxIter=10), steps)
        name = f"{len(steps)}"
        source, folder = str(tmp_path / f"in{name}"), str(tmp_path / f"out{name}")
        new = texts.drop("label")
        new.repartition(4).write.parquet(source)
        stream = spark.readStream.schema(new.schema).option("maxFilesPerTrigger", 1).parquet(source)
        classify.start_scoring(stream, model, folder, str(tmp_path / f"c{name}")).awaitTermination()
        got = spark.read.parquet(folder)
        assert got.select("batch_id").distinct().count() > 1
        want = {(r["k"], r["prediction"], r["sentiment"]) for r in classify.score_new(model, new).collect()}
        assert {(r["k"], r["prediction"], r["sentiment"]) for r in got.collect()} == want and got.count() == new.count()


def test_pipeline_without_a_classifier(spark, texts, tmp_path):
    fitted = Pipeline(stages=stages.text_pipeline(["k"], 4)[:3]).fit(texts)
    fitted.save(str(tmp_path / "p"))
    got = {r["k"]: r["padded"] for r in PipelineModel.load(str(tmp_path / "p")).transform(texts).collect()}
    assert len(got) == 20 and all(len(v) == 4 for v in got.values()) and got[4] == [0, 0, 0, 0]
