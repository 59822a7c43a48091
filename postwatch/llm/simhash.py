"""SimHash near-duplicates: fingerprints, compared exactly in tiles.

A fingerprint has 64 bits, set where over half of the shingles' hashes have them set.  Two
fingerprints link where at most ``radius`` bits differ.  Every fingerprint belongs to a cell, the bit
counts of its four quarters.  Quarters whose counts differ by n differ in n bits at least, so cells
further apart than the radius are skipped, which leaves a few of a hundred pairs.  Cells are cut into
tiles of bounded size; a pair of tiles is compared as one numpy matrix of exclusive ors.  A tile pair
gives a spanning forest of its links, not the links, so a group of n near copies costs about n rows.

Defined results: a text without words (null, empty, white space) has the fingerprint zero and is linked
like any other; fewer words than a shingle make one shingle; equal texts have equal fingerprints; an
empty table gives no rows; repeated rows all stay in ``link`` and one of them stays in ``dedupe``.
Other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwatch.llm.common import components, fresh, keep, keyed_join, text_hash

SHINGLE = 3
RADIUS = 3
SEED = 42
TILE = 2048
#: Quarters of a fingerprint, and the bits of each.
QUARTERS, WIDTH = 4, 16


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text, unsigned."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        starts = (ends - sizes)[:n].tolist()
        stops = (ends - 1)[shingle - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n
        )
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        block = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """``(doc_id, th, fp)`` of every row; ``th`` is a hash of the text, ``fp`` the fingerprint."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text_hash(text_col).alias("th"), F.col(text_col).alias("text")
    )
    kind = rows.schema["doc_id"].dataType

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            fps = np.fromiter(
                (fingerprint_of(texts[i].as_py(), shingle) for i in range(batch.num_rows)),
                np.uint64, batch.num_rows,
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(fps.view(np.int64))],
                ["doc_id", "th", "fp"],
            )

    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("th", T.LongType()), T.StructField("fp", T.LongType()),
    ])
    return rows.mapInArrow(run, schema)


def _close(a: np.ndarray, b: np.ndarray, radius: int, diagonal: bool):
    """Rows of ``a`` with the places of their close ones in ``b``; in blocks, so memory is bounded."""
    for at in range(0, len(a), 256):
        near = np.bitwise_count(a[at : at + 256, None] ^ b[None, :]) <= radius
        if diagonal:
            near &= np.arange(at, at + len(near))[:, None] < np.arange(len(b))[None, :]
        for i in np.flatnonzero(near.any(axis=1)):
            yield at + int(i), np.flatnonzero(near[i])


def _merge(label: np.ndarray, i: int, others: np.ndarray) -> None:
    """Give the classes of ``i`` and ``others`` the smallest of their labels."""
    found = np.unique(np.append(label[others], label[i]))
    if len(found) == 2:
        label[label == found[1]] = found[0]
    elif len(found) > 2:
        label[np.isin(label, found)] = found[0]


def within(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint of a tile, the place of its class's first one."""
    label = np.arange(len(fps))
    for i, near in _close(fps, fps, radius, True):
        _merge(label, i, near)
    return label


def across(a, la, b, lb, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Pairs (place in a, place in b) that join the classes of two tiles, a spanning forest of them."""
    label = np.concatenate([la, lb + len(a)])
    out = []
    for i, near in _close(a, b, radius, False):
        at = near + len(a)
        for k in np.unique(label[at], return_index=True)[1]:
            if label[at[k]] != label[i]:
                out.append((i, int(near[k])))
                low, high = sorted((label[at[k]], label[i]))
                label[label == high] = low
    return out


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of two cells' counts whose sum is at most the radius, one of each pair of signs."""
    span = range(-radius, radius + 1)
    near = [
        (a, b, c, d) for a in span for b in span for c in span for d in span
        if abs(a) + abs(b) + abs(c) + abs(d) <= radius
    ]
    return [x for x in near if x > (0,) * QUARTERS]


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` that connect the same classes as all pairs of ``fp`` within the radius.

    ``fps`` has distinct values in ``fp``.  Every pair of tiles that the cells allow is compared.
    """
    spark = fps.sparkSession
    counts = [
        F.bit_count(F.shiftrightunsigned("fp", WIDTH * k).bitwiseAND(F.lit((1 << WIDTH) - 1)))
        for k in range(QUARTERS)
    ]
    celled = fps.select("fp", *[c.cast("int").alias(f"c{k}") for k, c in enumerate(counts)])
    names = [f"c{k}" for k in range(QUARTERS)]
    # At most 17 ** 4 rows: small enough to broadcast at any size of the input.
    cells = keep(
        celled.groupBy(*names).agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles")), "cells"
    )
    packed = (
        celled.join(F.broadcast(cells), names)
        .withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
        .groupBy(*names, "t")
        .agg(F.collect_list("fp").alias("fps"))
    )

    def inside(batches):
        for batch in batches:
            fps, firsts = batch.column("fps").to_pylist(), []
            for x in fps:
                firsts.append(within(np.array(x, np.int64).view(np.uint64), radius).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), batch.column("t"), batch.column("fps"),
                 pa.array(firsts, pa.list_(pa.int32()))],
                [*names, "t", "fps", "firsts"],
            )

    tiles = keep(packed.mapInArrow(
        inside, ", ".join(f"{n} int" for n in names) + ", t int, fps array<long>, firsts array<int>"
    ), "tiles")
    inner = (
        tiles.select(F.explode(F.arrays_zip("fps", "firsts")).alias("x"), "fps")
        .select(F.col("x.fps").alias("a"), F.element_at("fps", F.col("x.firsts") + 1).alias("b"))
        .filter("a <> b")
    )
    # Which tiles meet: cells within the radius, and the tiles of one cell among themselves.
    steps = F.explode(F.array(*[F.array(*map(F.lit, x)) for x in _offsets(radius)])).alias("step")
    others = cells.select(*[F.col(n).alias(f"o{k}") for k, n in enumerate(names)], F.col("tiles").alias("more"))
    near = (
        cells.select(*names, "tiles", steps)
        .select(*names, "tiles", *[(F.col(n) + F.col("step")[k]).alias(f"o{k}") for k, n in enumerate(names)])
        .join(F.broadcast(others), [f"o{k}" for k in range(QUARTERS)])
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumn("ot", F.explode(F.sequence(F.lit(0), F.col("more") - 1)))
    )
    same = (
        cells.filter("tiles > 1")
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 2)))
        .withColumn("ot", F.explode(F.sequence(F.col("t") + 1, F.col("tiles") - 1)))
        .select(*names, *[F.col(n).alias(f"o{k}") for k, n in enumerate(names)], "t", "ot")
    )
    left = [*names, "t"]
    right = [*[f"o{k}" for k in range(QUARTERS)], "ot"]
    pairs = near.select(*left, *right).unionAll(same.select(*left, *right))
    second = tiles.select(
        *[F.col(a).alias(b) for a, b in zip(left, right)], F.col("fps").alias("ofps"), F.col("firsts").alias("ofirsts")
    )
    # Pairs come of explodes, and Spark would take them for as small as the cells.
    met = pairs.join(tiles.hint("merge"), left).join(second.hint("merge"), right).select("fps", "firsts", "ofps", "ofirsts")

    def outside(batches):
        def arrays(column):
            values = column.flatten().to_numpy(zero_copy_only=False)
            ends = column.offsets.to_numpy() - column.offsets[0].as_py()
            return [values[a:b] for a, b in zip(ends, ends[1:])]

        for batch in batches:
            a, b = [], []
            columns = [arrays(batch.column(i)) for i in range(4)]
            for x, lx, y, ly in zip(*columns):
                for i, j in across(x.view(np.uint64), lx, y.view(np.uint64), ly, radius):
                    a.append(int(x[i]))
                    b.append(int(y[j]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return inner.unionAll(met.mapInArrow(outside, "a long, b long"))


def classes(marked: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``(node, component)`` of the fingerprints in ``marked`` that link to others."""
    return components(links(marked.select("fp").distinct(), radius, tile))


def link(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    tile: int = TILE,
) -> DataFrame:
    """``(doc_id, th, fp, root, component_id)`` of every row.

    ``root`` is the class's smallest fingerprint and ``component_id`` the smallest id that links lead
    to.  A null id takes part and is never the smallest; a class of null ids alone has a null one.
    """
    marked = keep(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    roots = keep(classes(marked, radius, tile), "roots")
    firsts = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = keep(
        keyed_join(firsts, roots, [("fp", "node")], ["fp"]).select(
            F.col("fp").alias("of"), F.coalesce("component", "fp").alias("root"), "first"
        ),
        "rooted",
    )
    lows = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = keep(rooted.join(lows, "root").select("of", "root", "component_id"), "named")
    return keyed_join(marked, named, [("fp", "of")], ["doc_id", "th"]).select(
        "doc_id", "th", "fp", "root", "component_id"
    )


def dedupe(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile: int = TILE
) -> DataFrame:
    """One row of each class of near-duplicates, with the columns of ``docs``.

    The row with the smallest id stays (nulls last, then the smaller text hash); of rows that repeat
    both id and text, one stays.
    """
    linked = link(docs, id_col, text_col, radius=radius, tile=tile)
    copies = linked.groupBy("root", "doc_id", "th").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "n")
    wid, wth, n, th = fresh(docs, "_w_id", "_w_th", "_w_n", "_th")
    winners = keep(
        copies.groupBy("root")
        .agg(F.min(order).alias("w"))
        .select(F.col("w.doc_id").alias(wid), F.col("w.th").alias(wth), F.col("w.n").alias(n)),
        "winners",
    )
    rows = docs.withColumn(th, text_hash(text_col))
    keys = [(id_col, wid), (th, wth)]
    single = keyed_join(rows, winners.filter(F.col(n) == 1), keys, [id_col, th], "left_semi")
    repeated = keyed_join(rows, winners.filter(F.col(n) > 1), keys, [id_col, th], "left_semi")
    return single.unionAll(repeated.dropDuplicates([id_col, th])).select(*docs.columns)
