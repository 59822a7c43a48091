"""What a task of the index holds does not grow with the table."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from postwatch.operators import vectors


def unit_rows(n, width, seed):
    x = np.random.default_rng(seed).normal(size=(n, width))
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def test_nearest_centres_are_found_in_small_parts(spark):
    centres, x = unit_rows(2000, 4, 1), unit_rows(3000, 4, 2)
    batch = pa.RecordBatch.from_arrays([pa.array(x.tolist())], ["unit"])
    for probes in (1, 3):
        run = vectors._nearest_centres(spark, centres, probes)
        tracemalloc.start()
        cells = np.concatenate([b.column("cell").to_numpy() for b in run([batch])]).reshape(-1, probes)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        # All products at once take 48 MB.
        assert peak < 40e6
        assert (cells == np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]).all()


def test_centres_are_bounded_by_the_sample(spark):
    rows = [(i, r.tolist()) for i, r in enumerate(unit_rows(400, 3, 5))]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    index = vectors.build_index(df, "id", "vec", per_cell=2, sample=200)
    assert len(index.centres) <= 200 // vectors.PER_CENTRE
    assert index.cells.agg(F.count_distinct("key")).first()[0] == 400
