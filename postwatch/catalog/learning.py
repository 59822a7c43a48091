"""Queries of classifiers, sweeps, stored models and scoring."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.catalog import base as B
from postwatch.catalog.base import query
from postwatch.catalog.evaluation import RANKED, three_classes
from postwatch.catalog.sources import vector_words
from postwatch.operators import features, ordinal
from postwatch.plans import classify, descent, moments, stages
from postwatch.session import keep, new_folder
from postwatch.sources import tables


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, features`` in three classes, split by position."""
    rows = three_classes(spark, sf_dir).select(
        "vec_id", "label", array_to_vector("embedding").alias("features")
    )
    return ordinal.split_positional(rows, "vec_id")


def sql_bayes(label: str, part: str) -> str:
    """The metrics of class 1 on a part of the vectors, judged by Gaussian Bayes learnt from the training part.

    Every variance is raised by a billionth of the greatest one over all classes, as Spark does.
    """
    return f"""WITH {RANKED},
e AS (SELECT vec_id, {label} AS y, embedding,
             CASE WHEN r < t THEN 'test' WHEN r < 2 * t THEN 'valid' ELSE 'train' END AS split FROM r),
c AS (SELECT vec_id, y, split, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM e),
floor_ AS (SELECT 1e-9 * max(v) AS least FROM (SELECT var_pop(x) AS v FROM c WHERE split = 'train' GROUP BY pos)),
g AS (SELECT y AS k, pos, avg(x) AS m, var_pop(x) + any_value(least) AS v
      FROM c, floor_ WHERE split = 'train' GROUP BY y, pos),
prior AS (SELECT y AS k, ln(count(*) / sum(count(*)) OVER ()) AS p FROM e WHERE split = 'train' GROUP BY y),
scored AS (SELECT vec_id, y, k, any_value(p) - sum(ln(2 * pi() * v) + (x - m) * (x - m) / v) / 2 AS s
           FROM c JOIN g USING (pos) JOIN prior USING (k) WHERE split = '{part}' GROUP BY vec_id, y, k),
j AS (SELECT y, arg_max(k, s) AS z FROM scored GROUP BY vec_id, y),
n AS (SELECT count(*) AS n, count(*) FILTER (WHERE y = z) AS same, count(*) FILTER (WHERE y = 1) AS actual,
             count(*) FILTER (WHERE z = 1) AS predicted, count(*) FILTER (WHERE y = 1 AND z = 1) AS hits,
             count(*) FILTER (WHERE y <> 1 AND z <> 1) AS others FROM j)
SELECT round(same / n, 6) AS accuracy, round(hits / nullif(predicted, 0), 6) AS "precision",
       round(hits / nullif(actual, 0), 6) AS recall, round(2 * hits / nullif(actual + predicted, 0), 6) AS f1,
       round(others / nullif(n - actual, 0), 6) AS specificity FROM n"""


def _rounded(reports: DataFrame) -> DataFrame:
    return reports.select(*[
        F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in reports.dtypes
    ])


def _part(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter(F.col("split") == name)


def _labeled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text, label`` of the judged documents, split by position."""
    labels = B.table(spark, sf_dir, "labels")
    rows = B.documents(spark, sf_dir).join(labels, "doc_id").select(
        "doc_id", "text", F.col("quality").alias("label")
    )
    return keep(ordinal.split_positional(rows, "doc_id"), "labeled")


@query("lr_binary")
def lr_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labeled_texts(spark, sf_dir)
    model = classify.fit(
        _part(rows, "train"), classify.binary_regression(maxIter=20, regParam=0.01),
        classify.text_stages(),
    )
    return classify.report(classify.judged(model.transform(_part(rows, "valid"))))


@query("lr_multinomial")
def lr_multinomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    train = classify.weighted(_part(rows, "train"))
    model = classify.fit(train, classify.softmax_regression(maxIter=20, regParam=0.01))
    return classify.report(classify.judged(model.transform(_part(rows, "valid"))))


@query("nb_gaussian", sql_bayes("label % 3", "valid"))
def nb_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    model = classify.fit(_part(rows, "train"), classify.gaussian_bayes())
    return _rounded(classify.report(classify.judged(model.transform(_part(rows, "valid")))))


@query("svm_linear")
def svm_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    rows = rows.withColumn("label", F.when(F.col("label") == 2, 0).otherwise(F.col("label")))
    model = classify.fit(_part(rows, "train"), classify.linear_svc(maxIter=20, regParam=0.01))
    return classify.report(classify.judged(model.transform(_part(rows, "valid"))))


@query("sweep_leaderboard")
def sweep_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best runs with their settings; every model of the sweep is stored."""
    rows = _vectors(spark, sf_dir)
    runs = classify.sweep(
        classify.weighted(_part(rows, "train")), _part(rows, "valid"),
        classify.softmax_regression(), classify.grid(classify.SOFTMAX_GRID), models=new_folder(spark, "models"),
    )
    return classify.metrics.leaderboard(runs).drop("seconds")


@query("cv_grid")
def cv_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.weighted(three_classes(spark, sf_dir).select(
        "vec_id", "label", array_to_vector("embedding").alias("features")
    ))
    found, _ = classify.cross_validated(
        rows, "vec_id", classify.softmax_regression(maxIter=10), classify.grid({"regParam": [0.001, 0.1]})
    )
    return found


@query(
    "run_log",
    " UNION ALL ".join(
        f"SELECT 'class {k}' AS run, * FROM ({sql_bayes(f'CAST(label % 3 = {k} AS INTEGER)', 'valid')})" for k in (1, 2)
    ),
)
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per class against the others, logged one after the other."""
    rows = _vectors(spark, sf_dir)
    folder = new_folder(spark, "runs")
    for k in (1, 2):
        part = rows.withColumn("label", (F.col("label") == k).cast("int"))
        model = classify.fit(_part(part, "train"), classify.gaussian_bayes())
        scored = classify.judged(model.transform(_part(part, "valid")))
        classify.log_runs(classify.report(scored.withColumn("run", F.lit(f"class {k}")), by=["run"]), folder)
    return _rounded(spark.read.parquet(folder).drop("logged"))


@query("evaluate_saved", sql_bayes("label % 3", "test"))
def evaluate_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, stored = new_folder(spark, "data"), new_folder(spark, "model")
    tables.write_splits(_vectors(spark, sf_dir), data)
    model = classify.fit(tables.read_split(spark, data, "train"), classify.gaussian_bayes())
    model.save(stored)
    return _rounded(classify.evaluate_saved(stored, tables.read_split(spark, data, "test")))


@query("score_new_text")
def score_new_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labeled_texts(spark, sf_dir)
    model = classify.fit(
        _part(rows, "train"), classify.binary_regression(maxIter=10), classify.text_stages()
    )
    turns = B.conversations(spark, sf_dir).select("conv_id", "turn", "text")
    return classify.score_new(model, turns).drop("text")


@query("text_pipeline")
def text_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load, index and pad, split, store, train, report."""
    labels = B.table(spark, sf_dir, "labels")
    labeled = B.documents(spark, sf_dir).join(labels, "doc_id").select(
        "doc_id", "text", F.col("quality").alias("label")
    )
    # Four passes read them.
    labeled = keep(labeled, "labeled")
    vocabulary = features.kept_words(features.fit_vocabulary(labeled), features.NUM_WORDS)
    stored = vector_words(spark, sf_dir).drop("word")
    words = vocabulary.join(stored, vocabulary["idx"] - 2 == stored["vec_id"]).select("idx", "word", "vec")
    known = keep(features.with_special_rows(words, ["idx"]), "word_vectors")
    unknown = int(known.agg(F.max("idx")).first()[0])
    prepared, _ = classify.prepare(labeled, "doc_id", known, unknown)
    folder = new_folder(spark, "prepared")
    tables.write_splits(prepared, folder)
    # A text counts by the words it has: its padded indices as a sparse bag of words.
    bag = classify.CountVectorizer(inputCol="words", outputCol="features", binary=True)
    # The padding is 0, and no index lies below it.
    as_words = F.array_remove("indices", 0).cast("array<string>")

    def part(name: str) -> DataFrame:
        # Stored without the padding, as several passes read them.
        return keep(tables.read_split(spark, folder, name).select("doc_id", "label", as_words.alias("words")), name)

    model = classify.fit(part("train"), classify.binary_regression(maxIter=10), [bag])
    return classify.report(classify.judged(model.transform(part("valid"))))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, key, label, values`` in three classes, split by position."""
    rows = three_classes(spark, sf_dir).select(
        "vec_id", F.col("vec_id").alias("key"), "label", F.col("embedding").cast("array<double>").alias("values")
    )
    return keep(ordinal.split_positional(rows, "vec_id"), "values")


RATE = 0.5


def sql_steps() -> str:
    """Weights of a softmax regression after two steps of gradient descent from zero over all vectors."""
    return f"""WITH e AS (
  SELECT vec_id, label % 3 AS y, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) || [1.0] AS x FROM embeddings),
c AS (SELECT vec_id, y, unnest(x) AS x, generate_subscripts(x, 1) - 1 AS pos FROM e),
n AS (SELECT count(*) AS n FROM e),
k AS (SELECT unnest([0, 1, 2]) AS k),
w1 AS (SELECT pos, k, -{RATE} * sum(x * (1.0 / 3 - CASE WHEN y = k THEN 1 ELSE 0 END)) / any_value(n) AS w FROM c, k, n GROUP BY pos, k),
z AS (SELECT vec_id, y, k, exp(sum(x * w)) AS z FROM c JOIN w1 USING (pos) GROUP BY vec_id, y, k),
r AS (SELECT vec_id, k, z / sum(z) OVER (PARTITION BY vec_id) - CASE WHEN y = k THEN 1 ELSE 0 END AS r FROM z),
g AS (SELECT pos, k, sum(x * r) / any_value(n) AS g FROM c JOIN r USING (vec_id), n GROUP BY pos, k)
SELECT CAST(pos AS INTEGER) AS pos, CAST(k AS INTEGER) AS label, round(w - {RATE} * g, 6) + 0.0 AS weight FROM w1 JOIN g USING (pos, k)"""


@query("sgd_softmax", sql_steps())
def sgd_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps of gradient descent; the last place is the bias."""
    runs = descent.Descent.start(_values(spark, sf_dir), [{"learningRate": RATE, "optimizer": "sgd"}])
    for epoch in (1, 2):
        runs.epoch(epoch)
    # As many rows as the model has weights.
    rows = [(i, int(k), float(w)) for i, row in enumerate(runs.weights[0]) for k, w in zip(runs.classes, row)]
    found = spark.createDataFrame(rows, "pos int, label int, weight double")
    return found.withColumn("weight", F.round("weight", 6) + 0.0)


@query("lr_grid_sweep")
def lr_grid_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 140 settings of learning rate, epochs and optimizer, in as many passes as the most epochs."""
    rows = _values(spark, sf_dir)
    runs, _ = descent.sweep(_part(rows, "train"), _part(rows, "valid"))
    return _rounded(classify.metrics.leaderboard(runs))


@query("lr_grid_halving")
def lr_grid_halving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same axes by successive halving: all runs that were judged, with their rung."""
    rows = _values(spark, sf_dir)
    runs, _ = descent.halving(_part(rows, "train"), _part(rows, "valid"))
    return _rounded(runs)


@query("svm_rbf")
def svm_rbf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three classes, each against the others, with a Gaussian kernel."""
    rows = _values(spark, sf_dir)
    stages_ = stages.rbf_classifier(64, size=128, maxIter=8, regParam=0.01)
    model = classify.fit(_part(rows, "train"), stages_[-1], stages_[:-1])
    return classify.report(classify.judged(model.transform(_part(rows, "valid"))))


@query(
    "nb_stream_stats",
    """WITH c AS (SELECT label % 3 AS label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT CAST(label AS INTEGER) AS label, CAST(pos AS INTEGER) AS pos, count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(var_pop(x), 6) AS variance
FROM c GROUP BY ALL""",
)
def nb_stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of a stream of labelled vectors, merged batch by batch, with a batch that comes twice and a fold between."""
    source, folder = new_folder(spark, "vectors"), new_folder(spark, "moments")
    rows = three_classes(spark, sf_dir).select(F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    rows.repartition(6).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    moments.start_moments(stream, folder, new_folder(spark, "checkpoint")).awaitTermination()
    moments.compact(spark, folder)
    # A batch that has been folded changes nothing when it comes again.
    moments.add(rows, folder, "stream-0")
    found = moments.read(spark, folder)
    return found.select("label", "pos", "n", (F.round("mean", 6) + 0.0).alias("mean"), F.round("variance", 6).alias("variance"))


@query("nb_stream", sql_bayes("label % 3", "valid"))
def nb_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt from the training part in three batches, judged on the validation part."""
    rows, folder = _values(spark, sf_dir), new_folder(spark, "moments")
    train = _part(rows, "train")
    for batch in range(3):
        moments.add(train.filter(F.pmod(F.xxhash64("vec_id"), F.lit(3)) == batch), folder, f"batch-{batch}", "label", "values")
    valid = _part(rows, "valid")
    found = moments.predict(valid, moments.read(spark, folder), "vec_id", "values").join(valid.select("vec_id", "label"), "vec_id")
    return _rounded(classify.report(classify.judged(found)))


@query("stored_pipeline")
def stored_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, index, pad, average the word vectors, train; stored as one object, and judged as loaded."""
    rows = _labeled_texts(spark, sf_dir)
    train, valid = _part(rows, "train"), _part(rows, "valid")
    vectors = keep(vector_words(spark, sf_dir).select((F.col("vec_id") + 2).cast("int").alias("idx"), "vec"), "word_vectors")
    steps = stages.text_pipeline(["doc_id"], features.padded_length(train), vectors=vectors)
    folder = new_folder(spark, "pipeline")
    classify.fit(train, classify.binary_regression(maxIter=10, regParam=0.01), steps).save(folder)
    return classify.report(classify.judged(classify.PipelineModel.load(folder).transform(valid)))


@query("score_stream")
def score_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts scored as they come in, each micro-batch under its number."""
    rows = _labeled_texts(spark, sf_dir)
    model = classify.fit(_part(rows, "train"), classify.binary_regression(maxIter=10), classify.text_stages())
    turns = B.conversations(spark, sf_dir).select("conv_id", "turn", "text")
    source, folder = new_folder(spark, "turns"), new_folder(spark, "scored")
    turns.write.parquet(source)
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 4).parquet(source)
    classify.start_scoring(stream, model, folder, new_folder(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(folder).drop("text", "batch_id")
