"""Rows that have all features are multiplied as a matrix."""

import tracemalloc

import numpy as np
import pyarrow as pa

from postwatch.plans import descent


def batch(n, width, sparse):
    x = np.random.default_rng(3).normal(size=(n, width))
    at = pa.array([list(range(width))] * n, pa.list_(pa.int32())) if sparse else pa.nulls(n, pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays(
        [pa.array([0] * n, pa.int32()), at, pa.array(x.tolist()), pa.array([1.0] * n)], ["label", "positions", "values", "weight"])


def test_dense_rows_take_little_memory_and_have_the_same_scores():
    rows, scores = descent._chunks()
    weights = np.random.default_rng(4).normal(size=(33, 84))

    def found(sparse):
        given = batch(2000, 32, sparse)
        tracemalloc.start()
        parts = [scores(weights, at, x, ends) for at, x, ends, _, _ in rows([given], 84, [0], descent.CHUNK, 32)]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return np.concatenate(parts), peak

    dense, peak = found(False)
    assert np.allclose(dense, found(True)[0], atol=1e-12) and peak < 10e6
    # Products at once were 4,000,000 before, several copies of 32 MB each.
    assert found(True)[1] < 40e6


def test_gradient_of_dense_and_sparse_rows(spark):
    x = np.random.default_rng(5).normal(size=(60, 3))
    dense = [(i, i % 2, r.tolist()) for i, r in enumerate(x)]
    sparse = [(*r, [0, 1, 2]) for r in dense]
    a = descent._prepared(spark.createDataFrame(dense, "key long, label int, values array<double>"))
    b = descent._prepared(spark.createDataFrame(sparse, "key long, label int, values array<double>, positions array<int>"))
    weights = np.random.default_rng(6).normal(size=(2, 4, 2))
    for one, other in zip(descent.gradients(a, weights, [0, 1]), descent.gradients(b, weights, [0, 1])):
        assert np.allclose(one, other, atol=1e-12)
    # Rows that lack the last features are no full ones.
    ragged = descent._prepared(spark.createDataFrame([(1, 0, [1.0, 2.0, 3.0]), (2, 1, [4.0])], "key long, label int, values array<double>"))
    full = descent._prepared(spark.createDataFrame([(1, 0, [1.0, 2.0, 3.0]), (2, 1, [4.0, 0.0, 0.0])], "key long, label int, values array<double>"))
    assert np.allclose(descent.gradients(ragged, weights, [0, 1])[0], descent.gradients(full, weights, [0, 1])[0])
