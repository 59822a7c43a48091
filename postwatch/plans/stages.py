"""Text stages that are stored and loaded with a pipeline: cleaner, word indexer, padder, vector average, random features.

What a stage learns or needs as a table (the vocabulary, the word vectors) lies as Parquet beside its parameters, so a
loaded pipeline maps new texts as the stored one did.  Stages that look words up need the unique ``key`` of the
texts, as words are regrouped by it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.classification import OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.functions import arrays as A
from postwatch.functions import text as X
from postwatch.operators import features
from postwatch.operators.lookup import lookup_join
from postwatch.plans import classify
from postwatch.session import keep


class _Columns(HasInputCol, HasOutputCol, Params):
    @keyword_only
    def __init__(self, **given):
        super().__init__()
        self._set(**self._input_kwargs)


class Cleaner(_Columns, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The cleaned text."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), X.clean_text(F.col(self.getInputCol())))


class Padder(_Columns, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Index sequences brought to ``length``: filled up with 0, and cut where they are longer."""

    length = Param(Params._dummy(), "length", "length of all sequences", TypeConverters.toInt)

    def _transform(self, df: DataFrame) -> DataFrame:
        n = self.getOrDefault(self.length)
        return df.withColumn(self.getOutputCol(), A.trim(A.pad(F.col(self.getInputCol()), n), n))


class IndexWords(_Columns, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Indices without the padding as words, for a bag of words."""

    def _transform(self, df: DataFrame) -> DataFrame:
        words = F.transform(F.filter(self.getInputCol(), lambda i: i > 0), lambda i: i.cast("string"))
        return df.withColumn(self.getOutputCol(), words)


class _TableWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.table.write.parquet(f"{path}/table")


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.cls()
        stage._resetUid(found["uid"])
        DefaultParamsReader.getAndSetParams(stage, found)
        stage.table = self.sparkSession.read.parquet(f"{path}/table")
        return stage


class _Table(_Columns, MLWritable, MLReadable):
    """A stage with a stored table, which is saved along."""

    table: DataFrame
    key = Param(Params._dummy(), "key", "unique columns of a text", TypeConverters.toListString)

    def write(self):
        return _TableWriter(self)

    @classmethod
    def read(cls):
        return _TableReader(cls)

    def _by_key(self, df: DataFrame, found: DataFrame) -> DataFrame:
        return df.join(found, self.getOrDefault(self.key), "left")


class WordIndexer(_Columns, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the vocabulary of the training texts; words from ``numWords`` on count as unknown."""

    key = Param(Params._dummy(), "key", "unique columns of a text", TypeConverters.toListString)
    numWords = Param(Params._dummy(), "numWords", "bound of the indices", TypeConverters.toInt)

    def _fit(self, df: DataFrame) -> "WordIndexerModel":
        fitted = features.fit_vocabulary(df, self.getInputCol())
        model = WordIndexerModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), key=self.getOrDefault(self.key))
        model.table = keep(features.kept_words(fitted, self.getOrDefault(self.numWords)), "vocabulary")
        return model


class WordIndexerModel(_Table, Model):
    """Texts as arrays of word indices; a text without words has an empty one."""

    def _transform(self, df: DataFrame) -> DataFrame:
        key = self.getOrDefault(self.key)
        found = features.texts_to_sequences(df, key, self.table, self.getInputCol())
        return self._by_key(df, found.withColumnRenamed("indices", self.getOutputCol()))


class VectorAverage(_Table, Transformer):
    """The mean of the word vectors of the first ``length`` indices, as a vector; zeros where there are none.

    The table is ``(idx, vec)``.  Only places and keys are shuffled with the vectors, and they are averaged before that.
    """

    length = Param(Params._dummy(), "length", "indices looked at", TypeConverters.toInt)

    def _transform(self, df: DataFrame) -> DataFrame:
        key, n = self.getOrDefault(self.key), self.getOrDefault(self.length)
        places = df.select(*key, F.posexplode(F.slice(self.getInputCol(), 1, n)).alias("_pos", "idx")).filter("idx > 0")
        known = lookup_join(places, self.table.select("idx", "vec"), "idx", [*key, "_pos"], "inner")
        mean = known.groupBy(*key).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col("vec")))).alias("_mean"))
        width = self.table.agg(F.max(F.size("vec")).alias("n")).first()["n"] or 1
        none = F.array_repeat(F.lit(0.0), width)
        both = self._by_key(df, mean)
        return both.withColumn(self.getOutputCol(), array_to_vector(F.coalesce("_mean", none))).drop("_mean")


def directions(width: int, gamma: float, size: int, seed: int) -> np.ndarray:
    """A row per random feature: its direction, and its phase."""
    rng = np.random.default_rng(seed)
    return np.hstack([rng.normal(0, math.sqrt(2 * gamma), (size, width)), rng.uniform(0, 2 * math.pi, (size, 1))])


class RandomFeatures(_Columns, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features of the Gaussian kernel ``exp(-gamma * |x - y|^2)``.

    The inner product of the features of two rows estimates the kernel; its standard error is at most
    ``1 / sqrt(size)``, whatever the rows are.  The directions follow from ``seed``, so a loaded stage is the stored one.
    Features are array expressions over an array column.
    """

    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "length of the input", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "of the kernel", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "of the directions", TypeConverters.toInt)

    def column(self, values: Column) -> Column:
        # One literal, which the optimizer turns into an array once.
        rows = F.from_json(F.lit(json.dumps(directions(*map(self.getOrDefault, ("width", "gamma", "size", "seed"))).tolist())), "array<array<double>>")
        scale = math.sqrt(2 / self.getOrDefault(self.size))
        # The phase goes with a 1 behind the values.
        longer = F.concat(values.cast("array<double>"), F.array(F.lit(1.0)))
        return F.transform(rows, lambda w: F.cos(A.dot(w, longer)) * scale)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), array_to_vector(self.column(F.col(self.getInputCol()))))


def rbf_classifier(
    width: int, vec: str = "values", gamma: float | None = None, size: int = 256, seed: int = 7, **params
) -> list:
    """Stages of a support vector classifier with a Gaussian kernel, one class against the others.

    The linear classifier works on random features.  ``gamma`` is one over the width if it is not given.
    """
    mapped = RandomFeatures(
        inputCol=vec, outputCol="features", width=width, gamma=float(gamma if gamma is not None else 1 / width), size=size, seed=seed
    )
    return [mapped, OneVsRest(classifier=classify.linear_svc(**params), featuresCol="features", labelCol="label", parallelism=4)]


def text_pipeline(key: Sequence[str], length: int, num_words: int = features.NUM_WORDS, vectors: DataFrame | None = None) -> list:
    """Clean, index and pad; then a bag of words, or the average of ``vectors (idx, vec)``.

    The indexer gives no index from ``num_words`` on, so the vectors behind it are never met and not stored.
    """
    stages = [
        Cleaner(inputCol="text", outputCol="cleaned"),
        WordIndexer(inputCol="cleaned", outputCol="indices", key=list(key), numWords=num_words),
        Padder(inputCol="indices", outputCol="padded", length=length),
    ]
    if vectors is None:
        bag = classify.CountVectorizer(inputCol="known", outputCol="features", binary=True)
        return [*stages, IndexWords(inputCol="padded", outputCol="known"), bag]
    average = VectorAverage(inputCol="padded", outputCol="features", key=list(key), length=length)
    average.table = vectors.filter(F.col("idx") < num_words)
    return [*stages, average]
