"""Sums of the rows of a matrix."""

import pyarrow as pa
import pytest

from postwatch.catalog import features as catalog_features


@pytest.mark.parametrize("width", [3, None])
def test_sums_of_matrix_rows(width):
    rows = [[1.0, 2.0, 3.0], None, [0.5, -1.0, 4.0], [1.0, None, 2.0]]
    if width is None:
        rows[2] = [7.0, 8.0]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1] * 4), pa.array([2] * 4), pa.array([0, 1, 2, 3], pa.int32()), pa.array([3, 3, 3, 3], pa.int32()), pa.array(rows, pa.list_(pa.float64()))],
        ["conv_id", "turn", "pos", "n", "vec"])
    (out,) = catalog_features._row_sums()([batch])
    want = [None if r and None in r else sum(r or []) for r in rows]
    placed = [None if r and None in r else (i + 1) * sum(x * (j + 1) for j, x in enumerate(r or [])) for i, r in enumerate(rows)]
    assert out.column("total").to_pylist() == want and out.column("placed").to_pylist() == placed
