"""Gradient descent with the swept settings."""

import math
import random

import numpy as np
import pytest

from postwatch.plans import classify, descent


def toy(spark, n=200, seed=3, sparse=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = i % 3
        x = [rng.gauss(2.0 if j == y else 0.0, 1.0) for j in range(3)] + [rng.gauss(0, 1)]
        rows.append((i, y, x, [0, 2, 5, 6] if sparse else None, 0.5 + (i % 2)))
    return spark.createDataFrame(rows, "key long, label int, values array<double>, positions array<int>, weight double")


def mean_loss(rows, weights, classes):
    total = seen = 0.0
    for r in rows:
        x = np.zeros(weights.shape[0] - 1)
        x[r["positions"] or range(len(r["values"]))] = r["values"]
        z = x @ weights[:-1] + weights[-1]
        z = z - z.max()
        total -= r["weight"] * (z[classes.index(r["label"])] - math.log(np.exp(z).sum()))
        seen += r["weight"]
    return total / seen


@pytest.mark.parametrize("sparse", [False, True])
def test_gradient_agrees_with_differences(spark, sparse):
    df = toy(spark, 40, sparse=sparse)
    rows, classes = df.collect(), [0, 1, 2]
    width = 7 if sparse else 4
    weights = np.random.default_rng(0).normal(0, 0.5, (2, width + 1, 3))
    found, losses = descent.gradients(descent._prepared(df), weights, classes)
    for s in range(2):
        assert losses[s] == pytest.approx(mean_loss(rows, weights[s], classes))
        for at in [(0, 0), (2, 1), (3, 2), (width, 0)]:
            up, down = weights[s].copy(), weights[s].copy()
            up[at] += 1e-5
            down[at] -= 1e-5
            slope = (mean_loss(rows, up, classes) - mean_loss(rows, down, classes)) / 2e-5
            assert found[s][at] == pytest.approx(slope, abs=1e-6)


def test_small_chunks_give_the_same_gradient(spark, monkeypatch):
    df = descent._prepared(toy(spark, 60))
    weights = np.random.default_rng(1).normal(0, 0.5, (2, 5, 3))
    whole, _ = descent.gradients(df, weights, [0, 1, 2])
    monkeypatch.setattr(descent, "CHUNK", 20)
    parts, _ = descent.gradients(df, weights, [0, 1, 2])
    assert np.allclose(whole, parts)


def test_steps_by_hand():
    """Two steps of each optimizer from 1 with the gradients 0.5 and -0.25, worked out by hand."""
    gradients = [np.array([0.5]), np.array([-0.25])]

    def after(kind, rate):
        o, w, out = descent.Optimizer(kind, rate), np.array([1.0]), []
        for g in gradients:
            w = o.step(w, g)
            out.append(w[0])
        return out

    assert after("sgd", 0.1) == pytest.approx([0.95, 0.975])
    v1, v2 = 0.1 * 0.25, 0.9 * 0.1 * 0.25 + 0.1 * 0.0625
    first = 1 - 0.1 * 0.5 / (math.sqrt(v1) + 1e-7)
    assert after("rmsprop", 0.1) == pytest.approx([first, first + 0.1 * 0.25 / (math.sqrt(v2) + 1e-7)])
    first = 1 - 0.1 * 0.5 / (math.sqrt(0.1 + 0.25) + 1e-7)
    assert after("adagrad", 0.1) == pytest.approx([first, first + 0.1 * 0.25 / (math.sqrt(0.1 + 0.25 + 0.0625) + 1e-7)])
    m1, s1 = 0.05, 0.00025
    m2, s2 = 0.9 * m1 - 0.025, 0.999 * s1 + 0.001 * 0.0625
    first = 1 - 0.1 * (m1 / 0.1) / (math.sqrt(s1 / 0.001) + 1e-7)
    second = first - 0.1 * (m2 / (1 - 0.81)) / (math.sqrt(s2 / (1 - 0.999**2)) + 1e-7)
    assert after("adam", 0.1) == pytest.approx([first, second])
    with pytest.raises(ValueError):
        after("other", 0.1)


def test_all_settings_learn_in_one_run_of_passes(spark):
    df = toy(spark)
    settings = {"learningRate": [0.1, 0.001], "epochs": [3, 12], "optimizer": ["adam", "sgd"]}
    runs, state = descent.sweep(df, df, settings, batches=2)
    found = {r["run"]: r for r in runs.collect()}
    assert len(found) == 8 and set(found) == {classify.run_name(s) for s in classify.grid(settings)}
    assert found["learningRate=0.1,epochs=12,optimizer=adam"]["accuracy"] > 0.75
    assert (state.passes, state.steps) == (12, 48)
    # A setting alone takes the same steps as among the others.
    alone, _ = descent.sweep(df, df, {"learningRate": [0.1], "epochs": [12], "optimizer": ["adam"]}, batches=2)
    assert tuple(alone.first()) == tuple(found["learningRate=0.1,epochs=12,optimizer=adam"])


def test_losses_fall(spark):
    state = descent.Descent.start(toy(spark), [{"learningRate": 0.3, "optimizer": k} for k in ("sgd", "adam", "rmsprop", "adagrad")], 4)
    losses = [state.epoch(i) for i in range(1, 7)]
    assert (losses[-1] < 0.8 * losses[0]).all()


def slow(spark, n, seed):
    """Classes that only many steps tell apart: the signal is small beside the noise of other places."""
    rng = random.Random(seed)
    rows = [(i, i % 3, [rng.gauss(0.3 * (j == i % 3), 0.15) for j in range(3)] + [rng.gauss(1, 1), rng.gauss(0, 2)]) for i in range(n)]
    return spark.createDataFrame(rows, "key long, label int, values array<double>")


def test_halving_finds_the_winner_of_the_full_sweep(spark):
    train, valid = slow(spark, 300, 1), slow(spark, 300, 2)
    settings = {"learningRate": [1.0, 0.1, 0.001], "epochs": [2, 6, 18], "optimizer": ["adam", "sgd"]}
    full, all_of_it = descent.sweep(train, valid, settings)
    some, part = descent.halving(train, valid, settings)
    last = [r["run"] for r in descent.ranked(some.filter("rung = 2")).collect()]
    best = [r["run"] for r in descent.ranked(full).collect()]
    assert last[0] == best[0] == "learningRate=1.0,epochs=18,optimizer=adam" and len(last) == 2
    # Steps of single settings; and passes, against those of a sweep that trains each of the 18 settings alone.
    assert (part.steps, all_of_it.steps) == (6 * 2 + 3 * 4 + 2 * 12, 6 * 18)
    assert part.passes == all_of_it.passes == 18 < 6 * (2 + 6 + 18)
    assert {r["rung"]: r["count"] for r in some.groupBy("rung").count().collect()} == {0: 6, 1: 3, 2: 2}


def test_empty_rows_and_bounds(spark):
    df = spark.createDataFrame([(1, 0, [], None), (2, 1, None, None), (3, 1, [1.0], [2])], "key long, label int, values array<double>, positions array<int>")
    state = descent.Descent.start(df, [{"learningRate": 0.1, "optimizer": "sgd"}])
    state.epoch(1)
    # Rows without values move the bias alone.
    assert state.weights.shape == (1, 4, 2) and state.weights[0, 3, 1] > 0 > state.weights[0, 3, 0]
    with pytest.raises(ValueError):
        descent.gradients(descent._prepared(df), np.zeros((1000, 20_000, 2)), [0, 1])
