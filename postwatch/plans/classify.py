"""Text classification: features, classifiers, sweep, stored models, scoring."""

from __future__ import annotations

import itertools
import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import CountVectorizer, RegexTokenizer
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postwatch.functions import arrays as A
from postwatch.functions import text as X
from postwatch.operators import features, metrics, ordinal
from postwatch.session import keep, new_folder
from postwatch.sources import tables

# The swept settings.
CNN_GRID = {
    "learningRate": [0.001, 0.003, 0.006, 0.008, 0.01],
    "epochs": [10, 20, 40],
    "batchSize": [32],
    "filters": [64, 128],
    "dropout": [0.0, 0.1, 0.3, 0.5],
    "denseLayer": [128, 256, 512],
    "optimizer": ["ADAM", "ADADELTA", "RMSPROP"],
}
RNN_GRID = {
    "learningRate": [0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0],
    "momentum": [0],
    "epochs": [5, 10, 20, 40, 60],
    "batchSize": [32],
    "layerUnits1": [50],
    "kernelReg1": [0],
    "recuDropout1": [0],
    "dropout1": [0.0, 0.1, 0.3, 0.5],
    "layerUnits2": [50],
    "kernelReg2": [0],
    "recuDropout2": [0],
    "dropout2": [0.0, 0.1, 0.3, 0.5],
    "denseLayer1": [32, 64],
    "regulaDense1": [0],
    "denseLayer2": [1],
    "optimizer": ["RMSPROP"],
}
LR_GRID = {
    "learningRate": [0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0],
    "epochs": [5, 10, 20, 40, 60],
    "optimizer": ["rmsprop", "adam", "sgd", "adagrad"],
}
# The settings that a distributed softmax regression has in place of them.
SOFTMAX_GRID = {"regParam": [0.001, 0.01, 0.1], "maxIter": [10, 20]}


def text_stages(num_words: int = features.NUM_WORDS, text: str = "text") -> list:
    """Tokenizer and binary bag of words.  Vocabulary and vectors are sparse and bounded."""
    separators = "[" + "".join("\\" + c for c in X.TOKENIZER_SEPARATORS[:-2]) + r"\t\n ]+"
    return [
        RegexTokenizer(inputCol=text, outputCol="words", pattern=separators, minTokenLength=1),
        CountVectorizer(inputCol="words", outputCol="features", vocabSize=num_words, binary=True),
    ]


def weighted(df: DataFrame, label: str = "label") -> DataFrame:
    """Add the balanced class weight of each row.

    The weights are one row per class and stored, so Spark broadcasts them by their known size only.
    """
    weights = keep(metrics.class_weights(df, label).select(label, "weight"), "weights")
    return df.join(weights, label)


def binary_regression(**params) -> LogisticRegression:
    return LogisticRegression(family="binomial", **params)


def softmax_regression(**params) -> LogisticRegression:
    return LogisticRegression(family="multinomial", weightCol="weight", **params)


def gaussian_bayes(**params) -> NaiveBayes:
    return NaiveBayes(modelType="gaussian", **params)


def linear_svc(**params) -> LinearSVC:
    return LinearSVC(**params)


def fit(train: DataFrame, estimator: Estimator, stages: Sequence = ()) -> PipelineModel:
    return Pipeline(stages=[*stages, estimator]).fit(train)


def judged(predictions: DataFrame, label: str = "label") -> DataFrame:
    """``(y_true, y_pred)`` of scored rows."""
    return predictions.select(
        F.col(label).cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred")
    )


def report(predictions: DataFrame, by: Sequence[str] = (), positive: int = 1) -> DataFrame:
    """One row per run: accuracy, and the metrics of class ``positive``.

    The rows are read once, into one confusion matrix per run; the rest is arithmetic on it.
    """
    matrix = metrics.confusion_matrix(predictions, by=by)
    return metrics.per_class_metrics(matrix, by, [positive]).filter(F.col("label") == positive).drop("label")


def grid(values: Mapping[str, Sequence]) -> list[dict]:
    """All combinations of the listed settings, the last one varying fastest."""
    return [dict(zip(values, combo)) for combo in itertools.product(*values.values())]


def run_plan(df: DataFrame, label: str, values: Mapping[str, Sequence]) -> DataFrame:
    """One row per combination and class: the settings, and the class weight of the run.

    The combinations are exploded from literal lists next to the weights, one row per class.
    """
    out = metrics.class_weights(df, label)
    for name, choices in values.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(c) for c in choices])))
    return out


def run_name(settings: Mapping) -> str:
    return ",".join(f"{k}={v}" for k, v in settings.items())


def sweep(
    train: DataFrame,
    valid: DataFrame,
    estimator: Estimator,
    settings: Sequence[Mapping],
    parallelism: int = 4,
    models: str | None = None,
) -> DataFrame:
    """One row per combination: ``run``, its metrics on ``valid``, its settings and the ``seconds`` it took.

    Both tables need ``features`` and ``label``.  The features are stored once for all runs, several runs are
    fitted at a time, and each stores its one row of metrics.  In the folder ``models`` every fitted
    model is kept under the name of its run, for ``best_model``.
    """
    spark = train.sparkSession
    train, valid = keep(train, "train"), keep(valid, "valid")
    folder = new_folder(spark, "sweep")

    def one(setting: Mapping) -> None:
        start, name = time.perf_counter(), run_name(setting)
        model = estimator.fit(train, {estimator.getParam(k): v for k, v in setting.items()})
        if models is not None:
            PipelineModel([model]).write().overwrite().save(f"{models}/{name}")
        found = report(judged(model.transform(valid)).withColumn("run", F.lit(name)), by=["run"])
        row = keep(found, "metrics")
        seconds = F.lit(time.perf_counter() - start).alias("seconds")
        row.select("*", *[F.lit(v).alias(k) for k, v in setting.items()], seconds).write.mode("append").parquet(f"{folder}/{name}")

    with ThreadPoolExecutor(parallelism) as pool:
        list(pool.map(one, settings))
    return spark.read.parquet(*[f"{folder}/{run_name(s)}" for s in settings])


def best_model(runs: DataFrame, models: str) -> PipelineModel:
    """The stored model of the best run of a sweep."""
    return PipelineModel.load(f"{models}/{metrics.leaderboard(runs, 1).first()['run']}")


def cross_validated(
    df: DataFrame, key: str, estimator: Estimator, settings: Sequence[Mapping], folds: int = 3, parallelism: int = 4
) -> tuple[DataFrame, Model]:
    """``(run, f1)`` with the mean weighted F1 over the folds of each combination, and the best one's model.

    A row's fold follows from the hash of its ``key``, so reruns use the same folds.  The best model is
    fitted on all rows.
    """
    spark = df.sparkSession
    fold = F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")
    rows = keep(df.withColumn("_fold", fold), "folds")
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=[{estimator.getParam(k): v for k, v in x.items()} for x in settings],
        evaluator=MulticlassClassificationEvaluator(metricName="f1"), numFolds=folds, foldCol="_fold", parallelism=parallelism,
    ).fit(rows)
    found = [(run_name(x), float(m)) for x, m in zip(settings, search.avgMetrics)]
    return spark.createDataFrame(found, "run string, f1 double"), search.bestModel


def log_runs(reports: DataFrame, path: str) -> None:
    """Append run reports, with the time of logging, to the table of runs."""
    reports.withColumn("logged", F.current_timestamp()).write.mode("append").parquet(path)


def evaluate_saved(model_path: str, test: DataFrame) -> DataFrame:
    """Metrics of a stored model on a stored test set."""
    return report(judged(PipelineModel.load(model_path).transform(test)))


def score_new(model: PipelineModel, posts: DataFrame, names: Mapping = A.LABEL_NAMES) -> DataFrame:
    """Predictions for texts without a label; batch or stream."""
    scored = model.transform(posts).drop("words", "features", "rawPrediction", "probability")
    return scored.withColumn(
        "sentiment", A.label_name(F.col("prediction").cast("int"), names)
    )


def start_scoring(
    stream: DataFrame, model: PipelineModel, folder: str, checkpoint: str, names: Mapping = A.LABEL_NAMES
) -> StreamingQuery:
    """Score the texts of a stream and write each micro-batch under its number; a batch that is run again is replaced.

    A micro-batch is a table, so models whose stages join and regroup score streams as well.  What is there is taken,
    then the stream ends.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = score_new(model, batch, names)
        tables.write_batch(scored, folder, batch_id)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def _padded(sequences: DataFrame, length: int) -> DataFrame:
    indices = F.col("indices")
    return sequences.withColumn("indices", F.when(F.size(indices) > length, A.trim(indices, length)).otherwise(A.pad(indices, length)))


def padded_indices(
    texts: DataFrame, key: list[str], index: DataFrame, unknown: int, length: int
) -> DataFrame:
    """Index sequences brought to the training length: padded, and cut where they are longer."""
    return _padded(features.sentence_to_indices(texts, key, index, unknown), length)


def prepare(
    labeled: DataFrame, key: str, vectors: DataFrame, unknown: int, fraction: float = 0.2
) -> tuple[DataFrame, int]:
    """Index, pad and split labelled texts; the rows with ``indices`` and ``split``, and the length.

    ``labeled`` has the unique ``key``, ``text`` and ``label``.
    """
    length = features.padded_length(labeled)
    index = keep(features.word_index(vectors), "index")
    mapped = features.sentence_to_indices(labeled, [key], index, unknown)
    split = ordinal.split_positional(labeled.select(key, "label"), key, fraction)
    # Padded behind the join and the order in which splits are stored, so that no padding is shuffled or sorted.
    return _padded(mapped.join(split, key).sortWithinPartitions("split"), length), length


def gaussian_stats(df: DataFrame, label: str, vec: str) -> DataFrame:
    """``(label, pos, n, mean, variance)``: what a Gaussian naive Bayes model is made of."""
    cells = df.select(label, F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "x"))
    return cells.groupBy(label, "pos").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance")
    )
