"""Softmax regression by gradient descent with the swept settings: learning rate, epochs and optimizer.

All settings of a sweep take their steps together: one pass over the rows of a batch gives the gradients of every
live setting.  Each task sums the gradients of its own rows, and the sums meet in a ``groupBy`` over
the features; what comes to the driver is the gradient, whose size is features x classes x settings, as the
weights' is.  Settings that differ in their epochs alone are one run that is judged at each of them, so a sweep over
all epochs takes as many passes as its longest run.

``halving`` judges the live runs at each rung and goes on with the better part.

Rows have ``label``, ``values`` (array of double) and, for sparse rows, ``positions`` (array of int, the places
of the values), and a ``weight`` if they are not to count alike.  The last weight of a class is its bias.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwatch.operators import metrics
from postwatch.plans.classify import LR_GRID, run_name
from postwatch.session import keep

# Decay rates, starting sum of squares and the term that keeps quotients defined.
RMSPROP_DECAY = 0.9
ADAM_DECAY = (0.9, 0.999)
ADAGRAD_START = 0.1
TINY = 1e-7
#: Products that a task forms at once.
CHUNK = 1_000_000
#: Bytes of weights, over all live settings, that go to the tasks and back.
MOST_WEIGHTS = 256 * 1024 * 1024


@dataclass
class Optimizer:
    """One step of an optimizer; ``state`` is what it remembers of earlier gradients."""

    kind: str
    rate: float
    state: dict = field(default_factory=dict)

    def step(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        s = self.state
        if self.kind == "sgd":
            return weights - self.rate * gradient
        if self.kind == "rmsprop":
            s["v"] = RMSPROP_DECAY * s.get("v", 0.0) + (1 - RMSPROP_DECAY) * gradient**2
            return weights - self.rate * gradient / (np.sqrt(s["v"]) + TINY)
        if self.kind == "adagrad":
            s["v"] = s.get("v", ADAGRAD_START) + gradient**2
            return weights - self.rate * gradient / (np.sqrt(s["v"]) + TINY)
        if self.kind == "adam":
            a, b = ADAM_DECAY
            s["t"] = s.get("t", 0) + 1
            s["m"] = a * s.get("m", 0.0) + (1 - a) * gradient
            s["v"] = b * s.get("v", 0.0) + (1 - b) * gradient**2
            m, v = s["m"] / (1 - a ** s["t"]), s["v"] / (1 - b ** s["t"])
            return weights - self.rate * m / (np.sqrt(v) + TINY)
        raise ValueError(f"unknown optimizer {self.kind}")


def _chunks():
    """A function over the rows of a task that does not need this package where it runs."""

    def rows(batches, width: int, classes: list, chunk: int, n_features: int):
        """Places, values, row bounds, class numbers and weights, in parts of at most ``chunk`` products.

        Places are None where every row has all features.
        """
        number = {c: i for i, c in enumerate(classes)}
        for batch in batches:
            values, given = batch.column("values"), batch.column("positions")
            sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(sizes))
            x = values.flatten().to_numpy(zero_copy_only=False)
            dense = given.null_count > 0 and bool((sizes == n_features).all())
            if dense:
                at = None
            elif given.null_count:
                at = np.arange(len(x)) - np.repeat(ends[:-1], sizes)
            else:
                at = given.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            y = np.array([number.get(c, -1) for c in batch.column("label").to_pylist()])
            w = batch.column("weight").to_numpy(zero_copy_only=False)
            first = 0
            while first < len(sizes):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + chunk // width, "right")) - 1)
                last = min(last, first + max(1, chunk // width), len(sizes))
                part = slice(ends[first], ends[last])
                yield at if dense else at[part], x[part], ends[first : last + 1] - ends[first], y[first:last], w[first:last]
                first = last

    def scores(weights: np.ndarray, at, x, ends):
        """Scores of each row: rows x settings * classes; the last row of the weights is the bias."""
        if at is None:
            return x.reshape(len(ends) - 1, len(weights) - 1) @ weights[:-1] + weights[-1]
        out = np.tile(weights[-1], (len(ends) - 1, 1))
        full = np.flatnonzero(np.diff(ends))
        if len(full):
            out[full] += np.add.reduceat(weights[at] * x[:, None], ends[:-1][full], axis=0)
        return out

    return rows, scores


PARTIAL = "pos int, g array<double>"


def gradients(rows: DataFrame, weights: np.ndarray, classes: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the mean cross-entropy for every setting, and the mean losses.

    ``weights``: settings x (features + 1) x classes, as is the gradient.
    """
    n_settings, n_features, n_classes = weights.shape[0], weights.shape[1] - 1, weights.shape[2]
    if weights.nbytes > MOST_WEIGHTS:
        raise ValueError("features x classes x settings are too many; train fewer settings at a time")
    width = n_settings * n_classes
    flat = np.ascontiguousarray(weights.transpose(1, 0, 2).reshape(n_features + 1, width))
    shared = rows.sparkSession.sparkContext.broadcast(flat)
    each, scores = _chunks()
    names, chunk = list(classes), CHUNK

    def run(batches):
        w = shared.value
        total = np.zeros_like(w)
        # Behind the features: the bias, the losses (in the first places), and the rows' weights.
        loss, seen, touched = np.zeros(n_settings), 0.0, np.zeros(len(w), bool)
        for at, x, ends, y, weight in each(batches, width, names, chunk, n_features):
            z = scores(w, at, x, ends).reshape(len(y), n_settings, n_classes)
            z -= z.max(axis=2, keepdims=True)
            np.exp(z, out=z)
            z /= z.sum(axis=2, keepdims=True)
            own = z[np.arange(len(y)), :, y]
            loss -= (np.log(np.maximum(own, 1e-300)) * weight[:, None]).sum(axis=0)
            z[np.arange(len(y)), :, y] -= 1
            r = (z * weight[:, None, None]).reshape(len(y), width)
            seen += float(weight.sum())
            total[-1] += r.sum(axis=0)
            if at is None:
                total[:-1] += x.reshape(len(y), n_features).T @ r
                touched[:] = True
            elif len(at):
                parts = x[:, None] * np.repeat(r, np.diff(ends), axis=0)
                order = np.argsort(at, kind="stable")
                places, starts = np.unique(at[order], return_index=True)
                total[places] += np.add.reduceat(parts[order], starts, axis=0)
                touched[places] = True
        if seen:
            touched[-1] = True
            places = np.flatnonzero(touched)
            extra = np.zeros((1, width))
            extra[0, :n_settings] = loss
            found = np.concatenate([total[places], extra, np.full((1, width), seen)])
            pos = np.concatenate([places, [len(w), len(w) + 1]]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, width, dtype=np.int32)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(pos), lists], ["pos", "g"])

    summed = (
        rows.select("label", "positions", "values", "weight").mapInArrow(run, PARTIAL)
        .groupBy("pos").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("g")))).alias("g"))
        .toPandas()
    )
    shared.unpersist()
    out = np.zeros((n_features + 3, width))
    if len(summed):
        out[summed["pos"].to_numpy()] = np.stack(summed["g"].to_numpy())
    seen = max(out[-1, 0], TINY)
    gradient = (out[: n_features + 1] / seen).reshape(n_features + 1, n_settings, n_classes).transpose(1, 0, 2)
    return gradient, out[-2, :n_settings] / seen


def predictions(rows: DataFrame, weights: np.ndarray, classes: Sequence, names: Sequence[str]) -> DataFrame:
    """``(run, y_true, y_pred, n)``: the long confusion matrix of every setting, counted in the tasks first."""
    n_settings, n_features, n_classes = weights.shape[0], weights.shape[1] - 1, weights.shape[2]
    width = n_settings * n_classes
    flat = np.ascontiguousarray(weights.transpose(1, 0, 2).reshape(n_features + 1, width))
    shared = rows.sparkSession.sparkContext.broadcast(flat)
    each, scores = _chunks()
    labels, runs, chunk = list(classes), list(names), CHUNK

    def run(batches):
        n = np.zeros((n_settings, n_classes, n_classes), np.int64)
        for at, x, ends, y, _ in each(batches, width, labels, chunk, n_features):
            found = scores(shared.value, at, x, ends).reshape(len(y), n_settings, n_classes).argmax(axis=2)
            known = y >= 0
            np.add.at(n, (np.arange(n_settings)[None, :], y[known, None], found[known]), 1)
        s, t, p = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([runs[i] for i in s], pa.string()), pa.array([labels[i] for i in t], pa.int32()),
             pa.array([labels[i] for i in p], pa.int32()), pa.array(n[s, t, p])],
            ["run", "y_true", "y_pred", "n"],
        )

    found = rows.select("label", "positions", "values", "weight").mapInArrow(run, "run string, y_true int, y_pred int, n long")
    return found.groupBy("run", "y_true", "y_pred").agg(F.sum("n").alias("n"))


def _prepared(df: DataFrame) -> DataFrame:
    names = df.columns
    return df.select(
        *([F.col("key")] if "key" in names else []),
        F.col("label").cast("int").alias("label"), F.col("values").cast("array<double>").alias("values"),
        (F.col("positions") if "positions" in names else F.lit(None)).cast("array<int>").alias("positions"),
        (F.col("weight") if "weight" in names else F.lit(1.0)).cast("double").alias("weight"),
    )


@dataclass
class Descent:
    """Runs that go on together over the same rows; rows of a batch lie together, dealt by the hash of their ``key``."""

    rows: DataFrame
    settings: list[dict]
    n_features: int
    classes: list
    batches: int
    #: Passes over all rows, and steps of single settings that they stand for.
    passes: int = 0
    steps: int = 0

    @staticmethod
    def start(train: DataFrame, settings: Sequence[Mapping], batches: int = 1) -> "Descent":
        rows = _prepared(train)
        deal = F.pmod(F.xxhash64("key"), F.lit(batches)).cast("int") if batches > 1 else F.lit(0)
        rows = keep(rows.withColumn("batch", deal).repartition("batch", F.xxhash64("label", "values")), "descent")
        widest = F.greatest(F.max(F.size("values")), F.coalesce(F.max(F.array_max("positions")) + 1, F.lit(0)))
        n = rows.agg(F.coalesce(widest, F.lit(0)).alias("n")).first()["n"]
        classes = sorted(r["label"] for r in rows.select("label").distinct().collect())
        found = Descent(rows, [dict(s) for s in settings], int(n), classes, batches)
        found.weights = np.zeros((len(found.settings), int(n) + 1, len(classes)))
        found.optimizers = [Optimizer(s["optimizer"], s["learningRate"]) for s in found.settings]
        return found

    def epoch(self, number: int) -> np.ndarray:
        """One pass over all rows, a step per batch; gives the mean losses seen on the way."""
        order = np.random.default_rng(number).permutation(self.batches)
        losses = np.zeros(len(self.settings))
        for b in order:
            part = self.rows.filter(F.col("batch") == int(b)) if self.batches > 1 else self.rows
            gradient, loss = gradients(part, self.weights, self.classes)
            self.weights = np.stack([o.step(w, g) for o, w, g in zip(self.optimizers, self.weights, gradient)])
            losses += loss / self.batches
        self.passes += 1
        self.steps += len(self.settings)
        return losses

    def keep_only(self, places: Sequence[int]) -> None:
        self.settings = [self.settings[i] for i in places]
        self.optimizers = [self.optimizers[i] for i in places]
        self.weights = self.weights[list(places)]

    @staticmethod
    def name(setting: Mapping, epochs: int) -> str:
        return run_name({k: {**setting, "epochs": epochs}[k] for k in LR_GRID})

    def judged(self, valid: DataFrame, epochs: int, positive: int) -> DataFrame:
        """A row of metrics per live run after so many epochs, with its settings."""
        names = [self.name(s, epochs) for s in self.settings]
        matrix = predictions(valid, self.weights, self.classes, names)
        found = metrics.per_class_metrics(matrix, ["run"], [positive]).filter(F.col("label") == positive).drop("label")
        rows = [(n, float(s["learningRate"]), epochs, s["optimizer"]) for n, s in zip(names, self.settings)]
        settings = valid.sparkSession.createDataFrame(rows, "run string, learningRate double, epochs int, optimizer string")
        return found.join(F.broadcast(settings), "run")


def sweep(
    train: DataFrame, valid: DataFrame, settings: Mapping[str, Sequence] | None = None, batches: int = 1, positive: int = 1
) -> tuple[DataFrame, Descent]:
    """Every combination of the settings, each judged on ``valid``; all are trained in one run of passes."""
    grid = dict(settings or LR_GRID)
    each = [{"learningRate": r, "optimizer": o} for r in grid["learningRate"] for o in grid["optimizer"]]
    valid, runs = keep(_prepared(valid), "valid"), Descent.start(train, each, batches)
    found = []
    for epoch in range(1, max(grid["epochs"]) + 1):
        runs.epoch(epoch)
        if epoch in grid["epochs"]:
            found.append(keep(runs.judged(valid, epoch, positive), "runs"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out, runs


def halving(
    train: DataFrame, valid: DataFrame, settings: Mapping[str, Sequence] | None = None, batches: int = 1, positive: int = 1,
    share: int = 2,
) -> tuple[DataFrame, Descent]:
    """Successive halving: the epochs of the settings are the rungs.

    After each rung the best of ``share`` live runs go on, at least one.  Gives the metrics of all runs that were judged, with
    their ``rung``, and the descent, whose ``settings`` are the last live ones.
    """
    grid = dict(settings or LR_GRID)
    each = [{"learningRate": r, "optimizer": o} for r in grid["learningRate"] for o in grid["optimizer"]]
    valid, runs = keep(_prepared(valid), "valid"), Descent.start(train, each, batches)
    out, epoch, rungs = None, 0, sorted(grid["epochs"])
    for rung, until in enumerate(rungs):
        while epoch < until:
            epoch += 1
            runs.epoch(epoch)
        found = keep(runs.judged(valid, until, positive).withColumn("rung", F.lit(rung)), "rung")
        out = found if out is None else out.unionByName(found)
        if until < rungs[-1]:
            order = {r["run"]: i for i, r in enumerate(ranked(found).collect())}
            names = [runs.name(s, until) for s in runs.settings]
            best = sorted(range(len(names)), key=lambda i: order[names[i]])
            runs.keep_only(sorted(best[: max(1, -(-len(names) // share))]))
    return out, runs


def ranked(runs: DataFrame) -> DataFrame:
    """All runs in the order of a leaderboard, those that found nothing last."""
    return runs.orderBy(F.desc_nulls_last("f1"), F.desc_nulls_last("recall"), F.desc_nulls_last("precision"), "run")
