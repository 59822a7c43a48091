"""Line de-duplication by pairwise alignment with patience diff.

A document is aligned with earlier documents that share a block with it, until none of its lines that lie in
a shared block is left or all of them have been tried.  Documents that share lines are found through the lines' hashes.  From each line on, and
up to each line, as many lines are taken as make ``MIN_CHARS`` code points, often the line alone; such a run is
rare where a single short line is not, and every line of a block that can be deleted lies in one of the block's.  A run
leads from every document that has it to its earliest holder first; so a run in a third of all documents gives one
pair for each of them.  Only a run with lines that are still kept leads to its other earlier holders as well, in
rounds over growing parts of them.  Of documents with the same non-empty lines only the earliest is
aligned; the others are whole copies of it.  Every pair is aligned with
patience diff, and blocks of consecutive lines that are aligned, of at least ``MIN_CHARS`` code points
together, are deleted from the later document.  Blocks are judged on the input texts, not on what other
pairs leave.

Only line hashes travel.  A document that very many others are aligned with is copied over several
tasks, each with a bounded number of lines to compare, and pairs stream through a task one by one.

Defined results: lines are compared without white space at their ends; empty lines are never deleted
and do not end a block; a null text stays null; rows that share an id are never compared with each
other; a row without an id is later than all others and never earlier than any; repeated rows are
all treated alike; a document whose lines are all deleted has the empty text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwatch.llm.common import fresh, keep, keyed_join, text_hash
from postwatch.operators.ordinal import with_ordinal

MIN_CHARS = 60
#: Lines that one copy of an earlier document is compared with, about, unless it has more itself.
LOAD = 20_000
#: Holders that a run is tried with in the first round after its earliest one, and how many times as many in each next round.
GROWTH = 8
BLANKS = " \t\r\x0b\x0c"


def rising(places: list[int]) -> list[int]:
    """Indices of a longest strictly rising subsequence."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(places)
    for i, x in enumerate(places):
        k = bisect_left(tops, x)
        before[i] = at[k - 1] if k else -1
        tops[k : k + 1] = [x]
        at[k : k + 1] = [i]
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Patience diff: pairs of places of equal items, rising in both.

    Items that occur once on both sides are aligned along a longest rising sequence, equal ends are
    taken off first, and what lies between is aligned in the same way.
    """
    found = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: i for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1}
        single = [(place[x], j) for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1 and x in place]
        anchors = [single[i] for i in rising([i for i, _ in single])]
        if not anchors:
            continue
        found += anchors
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
            work.append((i + 1, k, j + 1, m))
    return sorted(found)


class Earlier:
    """An earlier document's non-empty lines, by hash."""

    def __init__(self, hashes: list[int], sizes: list[int]):
        self.lines = [h for h, n in zip(hashes, sizes) if n]
        self.at: dict[int, list[int]] = {}
        for i, h in enumerate(self.lines):
            self.at.setdefault(h, []).append(i)

    def blocks(self, hashes: list[int], sizes: list[int], min_chars: int = MIN_CHARS) -> list[int]:
        """Places of the later document's lines in aligned blocks that are long enough."""
        own = [i for i, n in enumerate(sizes) if n]
        shared = [k for k, i in enumerate(own) if hashes[i] in self.at]
        wanted = {hashes[own[k]] for k in shared}
        there = sorted(i for h in wanted for i in self.at[h])
        pairs = patience([self.lines[i] for i in there], [hashes[own[k]] for k in shared])
        aligned = [(there[i], shared[j]) for i, j in pairs]
        out: list[int] = []
        block: list[int] = []
        for n, (i, k) in enumerate(aligned):
            block.append(own[k])
            if n + 1 == len(aligned) or aligned[n + 1] != (i + 1, k + 1):
                if sum(sizes[x] for x in block) >= min_chars:
                    out += block
                block = []
        return out


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, th, hashes, sizes, seq)``: hash and length of each line, hash of the non-empty ones together."""
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))
    return docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col).alias("th"), lines.alias("lines")).select(
        "doc_id", "th",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"),
        F.transform("lines", lambda x: F.length(x)).alias("sizes"),
        F.xxhash64(F.filter("lines", lambda x: x != "")).alias("seq"),
    )


def windows(hashes: np.ndarray, sizes: np.ndarray, min_chars: int = MIN_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A document's runs ``(hash, start, stop)``, by places among its non-empty lines.

    From each line on, and up to each line, the fewest lines of ``min_chars`` together: all lines of a block
    that is long enough lie in such runs of the block.
    """
    import xxhash

    hashes, sizes = hashes[sizes > 0], sizes[sizes > 0]
    before = np.append(0, np.cumsum(sizes))
    n = len(hashes)
    stop = np.searchsorted(before, before[:-1] + min_chars, "left")
    start = np.searchsorted(before, before[1:] - min_chars, "right") - 1
    ahead, back = np.flatnonzero(stop <= n), np.flatnonzero(start >= 0)
    both = np.unique(np.concatenate([ahead * (n + 1) + stop[ahead], start[back] * (n + 1) + back + 1]))
    start, stop = both // (n + 1), both % (n + 1)
    out = hashes[start].astype(np.int64)
    several = np.flatnonzero(stop - start > 1)
    sent = hashes.astype(np.int64).tobytes()
    found = (xxhash.xxh64_intdigest(sent[8 * a : 8 * b]) for a, b in zip(start[several].tolist(), stop[several].tolist()))
    out[several] = np.fromiter(found, np.uint64, len(several)).view(np.int64)
    return out, start, stop


def runs_of(lines: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, th, h)``: the hash of each run of a document, once."""
    def run(batches):
        for batch in batches:
            hashes, sizes = batch.column("hashes"), batch.column("sizes")
            found = [
                np.unique(windows(hashes[i].values.to_numpy(), sizes[i].values.to_numpy(), min_chars)[0])
                for i in range(batch.num_rows)
            ]
            row = pa.array(np.repeat(np.arange(len(found)), list(map(len, found))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(row), batch.column("th").take(row),
                 pa.array(np.concatenate([np.zeros(0, np.int64), *found]))],
                ["doc_id", "th", "h"],
            )

    schema = T.StructType([lines.schema["doc_id"], lines.schema["th"], T.StructField("h", T.LongType())])
    return lines.select("doc_id", "th", "hashes", "sizes").mapInArrow(run, schema)


def kept_runs(lines: DataFrame, removed: DataFrame, runs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Those ``(doc_id, th, h, n)`` of ``runs`` with a line that is not among the removed ones."""
    wanted = (
        runs.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t"))
        .agg(F.collect_list(F.struct("h", "n")).alias("w"))
        .select("d", "t", F.col("w.h").alias("h"), F.col("w.n").alias("n"))
    )
    gone = removed.select(F.col("doc_id").alias("r"), F.col("th").alias("rt"), "removed")
    rows = (
        lines.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
        .join(gone, F.col("doc_id").eqNullSafe(F.col("r")) & (F.col("th") == F.col("rt")), "left")
        .select("doc_id", "th", "hashes", "sizes", "h", "n", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
    )

    def run(batches):
        for batch in batches:
            hashes, sizes, h, n, removed = (batch.column(c) for c in ("hashes", "sizes", "h", "n", "removed"))
            row, out, size = [], [], []
            for i in range(batch.num_rows):
                lengths = sizes[i].values.to_numpy()
                free = np.ones(len(lengths), np.int64)
                free[removed[i].values.to_numpy()] = 0
                free = np.append(0, np.cumsum(free[lengths > 0]))
                found, start, stop = windows(hashes[i].values.to_numpy(), lengths, min_chars)
                still = set(found[free[stop] > free[start]].tolist())
                for x, k in zip(h[i].as_py(), n[i].as_py()):
                    if x in still:
                        row.append(i)
                        out.append(x)
                        size.append(k)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("th").take(at), pa.array(out, pa.int64()), pa.array(size, pa.int64())],
                ["doc_id", "th", "h", "n"],
            )

    schema = T.StructType([
        lines.schema["doc_id"], lines.schema["th"], T.StructField("h", T.LongType()), T.StructField("n", T.LongType()),
    ])
    return rows.mapInArrow(run, schema).distinct()


def repeated_lines(lines: DataFrame, min_chars: int = MIN_CHARS, load: int = LOAD) -> DataFrame:
    """``(doc_id, th, removed)``: places of the lines to delete, for documents that have any."""
    classes = keep(
        lines.groupBy(F.col("seq").alias("same"))
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nameless"))
        .filter("least < most OR (least IS NOT NULL AND nameless > 0)")
        .select("same", "least"),
        "classes",
    )
    lines = keep(
        keyed_join(lines, classes, [("seq", "same")], ["doc_id", "th"])
        .withColumn("copy", F.coalesce(F.col("doc_id") > F.col("least"), F.col("least").isNotNull()))
        .select("doc_id", "th", "hashes", "sizes", "copy"),
        "classed",
    )
    places = F.filter(F.transform("sizes", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    copies = (
        lines.filter("copy").filter(total >= min_chars).select("doc_id", "th", places.alias("removed")).dropDuplicates(["doc_id", "th"])
    )
    lines = lines.filter("NOT copy").drop("copy")

    runs = runs_of(lines, min_chars)
    holders = (
        runs.groupBy("h")
        .agg(
            F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("doc_id").alias("n"),
            F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nameless"),
        )
        .filter("first < last OR (first IS NOT NULL AND nameless > 0)")
        .select(F.col("h").alias("shared"), "first", "n")
    )
    held = keep(
        keyed_join(runs, keep(holders, "holders"), [("h", "shared")], ["doc_id", "th"], "inner").select("doc_id", "th", "h", "first", "n"),
        "held",
    )
    left = held.filter("doc_id IS NULL OR doc_id > first")
    removed = keep(aligned(lines, keep(left.select("first", "doc_id", "th").distinct(), "pairs"), min_chars, load), "aligned")
    # A run that stays is tried with its other holders, in rounds over growing, distinct parts of them, to the last one.
    left = keep(kept_runs(lines, removed, left.select("doc_id", "th", "h", "n"), min_chars), "left")
    if left.isEmpty():
        return removed.unionAll(copies)
    numbered, starts = numbered_holders(held, left)
    done = 0
    while True:
        upto = max(1, done) * GROWTH
        # Each row meets the holders of its round by their numbers, so the work is that of the pairs tried.
        tried = keyed_join(left, starts, [("h", "of")], ["doc_id", "th"], "inner").select(
            "doc_id", "th", F.explode(F.sequence(F.lit(done).cast("long"), F.least(F.lit(upto), F.col("n")) - 1)).alias("k"), "start"
        )
        pairs = (
            keyed_join(tried.select("doc_id", "th", (F.col("start") + F.col("k")).alias("at")), numbered, [("at", "number")], ["doc_id", "th"], "inner", salts=1)
            .filter("doc_id IS NULL OR doc_id > first")
            .select("first", "doc_id", "th")
            .distinct()
        )
        more = aligned(lines, keep(pairs, "pairs"), min_chars, load)
        removed = keep(
            removed.unionAll(more).groupBy("doc_id", "th").agg(F.array_distinct(F.flatten(F.collect_list("removed"))).alias("removed")),
            "aligned",
        )
        done = upto
        left = keep(kept_runs(lines, removed, left.filter(F.col("n") > done), min_chars), "left")
        if left.isEmpty():
            break
    return removed.unionAll(copies)


def numbered_holders(held: DataFrame, left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(number, first)`` of the holders of the runs in ``left``, those of a run in a row, and ``(of, start)`` of each run.

    A run's holders are in the order of their hashes, so that a round meets earlier and later ones alike.
    """
    wanted = keep(left.select(F.col("h").alias("wanted")).distinct(), "wanted")
    rows = keyed_join(held.filter("doc_id IS NOT NULL"), wanted, [("h", "wanted")], ["doc_id", "th"], "inner")
    order = rows.select("h", F.xxhash64("doc_id", "h").alias("mix"), F.col("doc_id").alias("first"), "th")
    numbered = with_ordinal(order, "h", "mix", "first", "th", name="number")
    starts = numbered.groupBy(F.col("h").alias("of")).agg(F.min("number").alias("start"))
    return numbered.select("number", "first"), keep(starts, "starts")


def aligned(lines: DataFrame, pairs: DataFrame, min_chars: int = MIN_CHARS, load: int = LOAD) -> DataFrame:
    """``(doc_id, th, removed)`` of the later documents of ``pairs (first, doc_id, th)`` that have aligned blocks."""
    size = lines.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "hashes", "sizes")
    later = pairs.join(size, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).drop("d", "t")
    work = keep(later.groupBy("first").agg(F.sum(F.size("hashes")).alias("work")), "work")
    own = lines.select("doc_id", F.size("hashes").alias("n")).join(work, F.col("doc_id") == F.col("first"))
    share = F.greatest(F.lit(load), F.sum("n"))
    loads = keep(own.groupBy("first").agg(F.ceil(F.max("work") / share).cast("int").alias("copies")), "loads")
    earlier = (
        lines.join(loads, F.col("doc_id") == F.col("first"))
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .select("first", "copy", F.lit(0).alias("role"), "doc_id", "th", "hashes", "sizes")
    )
    spread = (
        later.join(loads, "first")
        .withColumn("copy", F.pmod(F.xxhash64("doc_id", "th"), F.col("copies")).cast("int"))
        .select("first", "copy", F.lit(1).alias("role"), "doc_id", "th", "hashes", "sizes")
    )
    kind = lines.schema["doc_id"].dataType

    def run(batches):
        now, known = None, {}
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("first", "copy", "role", "th")]
            hashes, sizes = batch.column("hashes"), batch.column("sizes")
            rows, removed = [], []
            for i, (first, copy, role, th) in enumerate(zip(*columns)):
                if (first, copy) != now:
                    now, known = (first, copy), {}
                if role == 0:
                    if th not in known:
                        known[th] = Earlier(hashes[i].as_py(), sizes[i].as_py())
                    continue
                h, n = hashes[i].as_py(), sizes[i].as_py()
                found = {x for e in known.values() for x in e.blocks(h, n, min_chars)}
                if found:
                    rows.append(i)
                    removed.append(sorted(found))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows)), batch.column("th").take(pa.array(rows)),
                     pa.array(removed, pa.list_(pa.int32()))],
                    ["doc_id", "th", "removed"],
                )

    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("th", T.LongType()),
        T.StructField("removed", T.ArrayType(T.IntegerType())),
    ])
    return (
        earlier.unionAll(spread)
        .repartition("first", "copy")
        .sortWithinPartitions("first", "copy", "role")
        .mapInArrow(run, schema)
        .groupBy("doc_id", "th")
        .agg(F.array_distinct(F.flatten(F.collect_list("removed"))).alias("removed"))
    )


def dedupe_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    counts: bool = False,
) -> DataFrame:
    """The rows of ``docs`` without repeated blocks of lines; with ``counts`` also ``n_lines``, ``n_removed``."""
    lines = keep(lines_of(docs, id_col, text_col), "lines")
    th, rid, rth, removed, n, total = fresh(docs, "_th", "_r_id", "_r_th", "_removed", "n_removed", "n_lines")
    gone = keep(
        repeated_lines(lines, min_chars).select(
            F.col("doc_id").alias(rid), F.col("th").alias(rth), F.col("removed").alias(removed)
        ),
        "removed",
    )
    joined = keyed_join(
        docs.withColumn(th, text_hash(text_col)), gone, [(id_col, rid), (th, rth)], [id_col, th]
    )
    whole = F.split(F.col(text_col), "\n")
    # The array of one binds the lines, so that they are split once and not once per line.
    left = F.transform(
        F.array(whole),
        lambda x: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(removed)), lambda i: F.get(x, i)
            ),
            "\n",
        ),
    )[0]
    out = joined
    if counts:
        n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(whole))
        out = out.withColumn(total, n_lines.cast("long")).withColumn(
            n, F.when(F.col(removed).isNull(), 0).otherwise(F.size(removed)).cast("long")
        )
    out = out.withColumn(text_col, F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(left))
    return out.select(*docs.columns, *([total, n] if counts else []))
