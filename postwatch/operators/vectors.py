"""Similarity of stored vectors: listed pairs, exact nearest vectors of many queries, and an index of cells.

Searches compare queries and vectors in cells of bounded size: each cell is a group of both, multiplied as two matrices,
which gives the ``k`` best of a query in the cell; these few rows are then ranked per query.  The exact search deals the
vectors into groups and the queries into blocks and compares every pair of them.  The index deals vectors by their nearest
centre, and a query only goes to the cells of its nearest centres; a cell that holds too many vectors is split.

Cosines are ranked after rounding to ``DIGITS``, ties by the key; those of zero vectors are null and come last.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwatch.functions import arrays as A
from postwatch.session import keep

#: Vectors, and queries, that meet in one cell.
CELL_VECTORS = 20_000
CELL_QUERIES = 5_000
#: Queries that a cell holds at most where more of them save copies of the vectors, and how many copies are made before.
MOST_QUERIES = 50_000
COPIES = 4
DIGITS = 12
#: Vectors that the centres are learnt from, at most, and on average in a cell of the index.
SAMPLE = 100_000
PER_CELL = 1_000
#: Vectors of the sample that a centre is learnt from on average, at least.
PER_CENTRE = 40
#: Products of rows and centres that a task forms at once.
PRODUCTS = 1_000_000


def cosine_of_pairs(
    pairs: DataFrame, vectors: DataFrame, left: str, right: str, key: str, vec: str
) -> DataFrame:
    """Cosine of each listed pair of vectors; ``pairs`` names them by their keys."""
    a = vectors.select(F.col(key).alias(left), F.col(vec).alias("_u"))
    b = vectors.select(F.col(key).alias(right), F.col(vec).alias("_v"))
    joined = pairs.join(a, left).join(b, right)
    return joined.withColumn("cosine", A.cosine(F.col("_u"), F.col("_v"))).drop("_u", "_v")


def _best_of_cell(k: int, digits: int, names: list[str]):
    """Compares the queries of a cell with its vectors; needs nothing of this package where it runs."""

    def units(column) -> np.ndarray:
        rows = column.combine_chunks()
        values = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        flat = values.reshape(len(rows), -1) if len(rows) else values.reshape(0, 0)
        size = np.sqrt((flat * flat).sum(axis=1, keepdims=True))
        with np.errstate(divide="ignore", invalid="ignore"):
            return flat / size

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out_q, out_v, cosines = [], [], []
        if queries.num_rows and vectors.num_rows:
            # In the order of the keys, so that a stable sort breaks ties by them.
            vectors = vectors.take(pa.compute.sort_indices(vectors.column("key")))
            left, right = units(queries.column("vec")), units(vectors.column("vec"))
            step = max(1, 4_000_000 // len(right))
            for at in range(0, len(left), step):
                found = np.round(left[at : at + step] @ right.T, digits)
                found[np.isnan(found)] = -np.inf
                most = min(k, found.shape[1])
                least = np.partition(found, -most, axis=1)[:, -most]
                for i, row in enumerate(found):
                    places = np.flatnonzero(row >= least[i])
                    places = places[np.argsort(-row[places], kind="stable")][:most]
                    out_q.extend([at + i] * len(places))
                    out_v.extend(places.tolist())
                    cosines.extend(None if x == -np.inf else x for x in row[places].tolist())
        return pa.table(
            [queries.column("query").take(pa.array(out_q, pa.int64())), vectors.column("key").take(pa.array(out_v, pa.int64())),
             pa.array(cosines, pa.float64())],
            names=names,
        )

    return run


def _search(queries: DataFrame, vectors: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` best of each query over the cells it has rows in.

    ``queries (cell, query, vec)`` and ``vectors (cell, key, vec)``; a vector is in one cell that a query meets.
    """
    schema = T.StructType([
        T.StructField("query", queries.schema["query"].dataType), T.StructField(key, vectors.schema["key"].dataType),
        T.StructField("cosine", T.DoubleType()),
    ])
    best = queries.groupBy("cell").cogroup(vectors.groupBy("cell")).applyInArrow(_best_of_cell(k, DIGITS, ["query", key, "cosine"]), schema)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc_nulls_last("cosine"), key))
    return best.withColumn("place", place).filter(F.col("place") <= k)


def _doubles(df: DataFrame, key: str, vec: str, name: str) -> DataFrame:
    """Key and vector; rows without a vector cannot be compared and are left out."""
    return df.filter(F.col(vec).isNotNull()).select(F.col(key).alias(name), F.col(vec).cast("array<double>").alias("vec"))


def _dealt(n: int, asked: int, most: int) -> int:
    """Parts of ``asked`` rows as long as these are few; then larger ones, of at most ``most`` rows."""
    return max(1, min(math.ceil(n / asked), max(COPIES, math.ceil(n / max(asked, most)))))


def most_similar(
    queries: DataFrame, vectors: DataFrame, key: str, vec: str, k: int = 5, cell_vectors: int = CELL_VECTORS, cell_queries: int = CELL_QUERIES
) -> DataFrame:
    """The ``k`` nearest vectors of each query ``(query, vec)`` by cosine, exactly: ``(query, key, cosine, place)``.

    Queries and keys are unique.  Every query is compared with every vector, in cells of about ``cell_queries`` x
    ``cell_vectors``: the vectors are copied once per block of queries, the queries once per group of vectors.  Cells that are
    smaller than a task can hold grow with the tables, so that either side is copied a bounded number of times up to
    ``COPIES * MOST_QUERIES`` queries and ``COPIES * CELL_VECTORS`` vectors, and more slowly than by the size asked for behind.
    """
    asked, stored = _doubles(queries, "query", vec, "query"), _doubles(vectors, key, vec, "key")
    n_queries, n_vectors = asked.count(), stored.count()
    blocks = _dealt(n_queries, cell_queries, MOST_QUERIES)
    groups = _dealt(n_vectors, cell_vectors, CELL_VECTORS)
    # Small tables too are spread over the cores.
    groups = max(groups, min(vectors.sparkSession.sparkContext.defaultParallelism, n_vectors // 1000))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks))
    group = F.pmod(F.xxhash64("key"), F.lit(groups))
    each_group, each_block = (F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")) for n in (groups, blocks))
    left = asked.select(F.explode(F.transform(each_group, lambda g: block * groups + g)).alias("cell"), "query", "vec")
    right = stored.select(F.explode(F.transform(each_block, lambda b: b * groups + group)).alias("cell"), "key", "vec")
    return _search(left, right, key, k)


@dataclass
class Index:
    """An inverted file: vectors by cell, ``(cell, part, key, vec)``, the parts of each cell, and the centres."""

    cells: DataFrame
    parts: DataFrame
    centres: np.ndarray
    key: str


def build_index(
    vectors: DataFrame, key: str, vec: str, per_cell: int = PER_CELL, sample: int = SAMPLE, seed: int = 7, cell_vectors: int = CELL_VECTORS
) -> Index:
    """Index all vectors by the nearest of the centres, which are learnt from about ``sample`` of them, picked by hash.

    There are so many cells that each has about ``per_cell`` vectors, but no more than the sample can tell apart: beyond that
    cells grow with the table, and the centres, which every task holds, do not.
    A cell of more than ``cell_vectors`` is cut into parts by the hash of the key, so a crowded spot fills several tasks.
    Zero vectors, which are near to nothing, lie in the first cell.
    """
    rows = _doubles(vectors, key, vec, "key")
    size = A.norm(F.col("vec"))
    rows = keep(rows.withColumn("unit", F.when(size > 0, F.transform("vec", lambda x: x / size)).otherwise(F.col("vec"))), "units")
    n = rows.count()
    n_cells = max(1, min(round(n / per_cell), sample // PER_CENTRE))
    share = min(1.0, sample / max(1, n))
    picked = rows.filter(F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 20)) < share * (1 << 20)).filter(A.norm(F.col("unit")) > 0)
    learnt = picked.select(array_to_vector("unit").alias("features"))
    if not learnt.isEmpty():
        model = KMeans(k=max(2, n_cells), seed=seed, maxIter=20).fit(learnt)
        centres = np.array(model.clusterCenters())
    else:
        centres = np.zeros((1, 1))
    placed = rows.mapInArrow(_nearest_centres(vectors.sparkSession, centres, 1), _with_cell(rows))
    counted = placed.groupBy("cell").agg(F.count("*").alias("n"))
    parts = keep(counted.select("cell", F.ceil(F.col("n") / cell_vectors).cast("long").alias("parts")), "parts")
    # One row per cell.
    cut = placed.join(F.broadcast(parts), "cell")
    cells = keep(cut.select("cell", F.pmod(F.xxhash64("key"), F.col("parts")).alias("part"), "key", "vec").repartition("cell", "part"), "cells")
    return Index(cells, parts, centres, key)


def _with_cell(rows: DataFrame) -> T.StructType:
    return T.StructType([*rows.schema.fields, T.StructField("cell", T.LongType())])


def _nearest_centres(spark, centres: np.ndarray, probes: int):
    """Adds the ``probes`` centres nearest to ``unit`` by cosine, a row each."""
    size = np.sqrt((centres * centres).sum(axis=1, keepdims=True))
    shared = spark.sparkContext.broadcast(centres / np.where(size > 0, size, 1))
    products = PRODUCTS

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = batch.column(batch.schema.get_field_index("unit"))
            flat = unit.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            known = shared.value.T if shared.value.shape[1] == flat.shape[1] else np.zeros((flat.shape[1], 1))
            most = min(probes, known.shape[1])
            step, parts = max(1, products // known.shape[1]), []
            for at in range(0, len(flat), step):
                near = flat[at : at + step] @ known
                parts.append(near.argmax(axis=1)[:, None] if most == 1 else np.argsort(-near, axis=1, kind="stable")[:, :most].copy())
            cells = np.concatenate(parts)
            rows = pa.array(np.repeat(np.arange(batch.num_rows), most))
            columns = [c.take(rows) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cells.ravel().astype(np.int64))], [*batch.schema.names, "cell"])

    return run


def search_index(index: Index, queries: DataFrame, vec: str, k: int = 5, probes: int = 8, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """The ``k`` nearest vectors of each query in the cells of its ``probes`` nearest centres.

    Where more than ``cell_queries`` queries go to a cell they are dealt into blocks, and its vectors are copied for each.
    """
    asked = _doubles(queries, "query", vec, "query")
    size = A.norm(F.col("vec"))
    asked = asked.withColumn("unit", F.when(size > 0, F.transform("vec", lambda x: x / size)).otherwise(F.col("vec")))
    sent = keep(asked.mapInArrow(_nearest_centres(queries.sparkSession, index.centres, probes), _with_cell(asked)), "sent")
    blocks = sent.groupBy("cell").agg(F.ceil(F.count("*") / cell_queries).cast("long").alias("blocks"))
    # One row per cell.
    cells = F.broadcast(keep(index.parts.join(blocks, "cell"), "blocks"))
    each_part, each_block = (F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)) for n in ("parts", "blocks"))
    left = sent.join(cells, "cell").select("cell", F.pmod(F.xxhash64("query"), F.col("blocks")).alias("block"), each_part.alias("part"), "query", "vec")
    right = index.cells.join(cells, "cell").select("cell", each_block.alias("block"), "part", "key", "vec")
    number = F.concat_ws(" ", "cell", "block", "part").alias("cell")
    return _search(left.select(number, "query", "vec"), right.select(number, "key", "vec"), index.key, k)
