"""Substring de-duplication by relative Lempel-Ziv factors.

The reference of a document is all text before it: documents with smaller ids, and its own earlier words.  It
is indexed in blocks.  A block is cut out by the text itself: among the ``GRAM``-word sequences of a window
of ``WINDOW`` words the one with the smallest hash is the window's key, and neighbouring windows with one
key form a block.  Equal windows have equal keys, so a block need only be compared with the indexed blocks
of its key, wherever they stand, and the index is dealt over the cluster by key.

A block is parsed greedily against them: a factor begins at the first window that occurs earlier and goes on
as long as the next window does too.  Factors are ``WINDOW`` words long at least.  At the factors'
boundaries, where the greedy parse would lose windows that reach from one block into the next, the
factors of neighbouring blocks join, as each window is looked up in its own block; so a word is a duplicate
exactly if some window over it occurs earlier.

What a task has seen already itself is not sent, so a passage that a third of all documents share is sent
once per task.  Windows are compared by 104 bits of hash.

Defined results: ids are integers; a null text has no words; a null id comes after all others; rows that
share an id are in the order of a hash of their texts; rows that repeat id and text are one document and
get the same result; a text of fewer words than a window loses none; results are judged on the input texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwatch.llm.common import fresh, keep, keyed_join, text_hash

WINDOW = 20
GRAM = 8
#: Words of a task that are searched for repeats at once, unless one text has more.
CHUNK_WORDS = 1 << 20
LAST = np.iinfo(np.int64).max
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a window's hash that are sent besides the key.
SENT = 5


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def sequences(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` words in a row, from the words' hashes."""
    out, size = None, 0
    block, width, power = h, 1, PRIME
    while n:
        if n & 1:
            if out is None:
                out, size = block, width
            else:
                m = len(h) - size - width + 1
                out = out[:m] * power + block[size : size + m]
                size += width
        n >>= 1
        if n:
            m = len(h) - 2 * width + 1
            block = block[: max(m, 0)] * power + block[width : width + max(m, 0)]
            width, power = 2 * width, power * power
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(words: list[bytes], window: int = WINDOW, gram: int = GRAM):
    """Window hashes, and the blocks: first window, number of windows, key."""
    import xxhash

    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        wide = mixed(sequences(h, window))
        keys = mixed(sequences(h, gram))
    view = np.lib.stride_tricks.sliding_window_view(keys, window - gram + 1)
    at = np.arange(len(wide)) + view.argmin(axis=1)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return wide, first, np.diff(np.append(first, len(wide))), keys[at[first]]


def repeats(key: np.ndarray, extra: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which windows are equal to one that stands earlier.  ``doc`` numbers the documents in their order.

    The windows must be sorted by ``doc`` and ``pos``; the same place twice counts as one.
    """
    order = np.argsort(key, kind="stable")
    k, e, d, p = key[order], extra[order], doc[order], pos[order]
    new = np.append(True, (k[1:] != k[:-1]) | (e[1:] != e[:-1]))
    head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    out = np.zeros(len(k), bool)
    out[order] = (d != d[head]) | (p != p[head])
    return out


def factors(repeated: np.ndarray, doc: np.ndarray, pos: np.ndarray):
    """Runs of repeated windows in a row: place of each first one, and the position after each last one."""
    at = np.flatnonzero(repeated)
    if not len(at):
        return at, at
    cut = np.append(True, (np.diff(at) != 1) | (doc[at[1:]] != doc[at[:-1]]) | (pos[at[1:]] != pos[at[:-1]] + 1))
    return at[cut], pos[at[np.append(np.flatnonzero(cut)[1:], len(at)) - 1]] + 1


def _numbers(docs: np.ndarray, ths: np.ndarray) -> np.ndarray:
    """Number of each row's document, in a table sorted by them."""
    return np.cumsum(np.append(False, (docs[1:] != docs[:-1]) | (ths[1:] != ths[:-1])))


SENT_SCHEMA = "key long, doc long, th long, pos int, stop int, windows binary"


def _send(rows: list[tuple], window: int, gram: int):
    """Blocks of a task's documents whose windows it has not all seen earlier, and its own factors."""
    rows = sorted(rows, key=lambda r: r[:2])
    parsed = [(d, th, *blocks(w, window, gram)) for d, th, w in rows]
    sizes = [len(x[2]) for x in parsed]
    wide = np.concatenate([x[2] for x in parsed])
    docs, ths = (np.repeat(np.array([x[i] for x in parsed], np.int64), sizes) for i in (0, 1))
    pos = np.concatenate([np.arange(n) for n in sizes])
    number = _numbers(docs, ths)
    again = repeats(wide, wide, number, pos)
    begin, stop = factors(again, number, pos)
    none = np.zeros(len(begin), np.int64)
    yield _batch(none + 1, docs[begin], ths[begin], pos[begin], stop, [b""] * len(begin))
    shift = np.cumsum(sizes) - sizes
    first = np.concatenate([x[3] + s for x, s in zip(parsed, shift)])
    counts = np.concatenate([x[4] for x in parsed])
    keys = np.concatenate([x[5] for x in parsed]).view(np.int64)
    fresh_ones = np.add.reduceat((~again).astype(np.int64), first) > 0
    first, counts, keys = first[fresh_ones], counts[fresh_ones], keys[fresh_ones]
    low = wide.view(np.uint8).reshape(-1, 8)[:, :SENT].tobytes()
    sent = [low[SENT * a : SENT * (a + n)] for a, n in zip(first.tolist(), counts.tolist())]
    yield _batch(keys, docs[first], ths[first], pos[first], np.full(len(first), -1), sent)


def _batch(keys, docs, ths, pos, stop, sent) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(docs), pa.array(ths), pa.array(pos.astype(np.int32)),
         pa.array(np.asarray(stop).astype(np.int32)), pa.array(sent, pa.binary())],
        ["key", "doc", "th", "pos", "stop", "windows"],
    )


def send_blocks(batches, window: int, gram: int):
    rows, size = [], 0
    for batch in batches:
        docs, ths = batch.column("doc").to_pylist(), batch.column("th").to_pylist()
        texts = batch.column("text")
        for i, (doc, th) in enumerate(zip(docs, ths)):
            words = split_words(texts[i].as_py())
            if len(words) < window:
                continue
            if rows and size + len(words) > CHUNK_WORDS:
                yield from _send(rows, window, gram)
                rows, size = [], 0
            rows.append((LAST if doc is None else doc, th, words))
            size += len(words)
    if rows:
        yield from _send(rows, window, gram)


def match_blocks(batches):
    """Factors of the blocks of each key, for rows sorted by group, document and position."""
    held: list[pa.RecordBatch] = []

    def work(rows: pa.Table):
        done = rows.filter(pa.compute.greater_equal(rows.column("stop"), 0))
        if done.num_rows:
            yield from done.select(["doc", "th", "pos", "stop"]).combine_chunks().to_batches()
        rows = rows.filter(pa.compute.less(rows.column("stop"), 0))
        if not rows.num_rows:
            return
        sent = b"".join(rows.column("windows").to_pylist())
        keys, docs, ths, pos = (rows.column(n).to_numpy() for n in ("key", "doc", "th", "pos"))
        extra = np.zeros((len(sent) // SENT, 8), np.uint8)
        extra[:, :SENT] = np.frombuffer(sent, np.uint8).reshape(-1, SENT)
        extra = extra.view(np.uint64).ravel()
        counts = pa.compute.binary_length(rows.column("windows")).to_numpy() // SENT
        row = np.repeat(np.arange(len(counts)), counts)
        at = pos[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        number = _numbers(docs, ths)[row]
        key = keys.view(np.uint64)[row]
        with np.errstate(over="ignore"):
            both = mixed(key + extra * PRIME)
        begin, stop = factors(repeats(both, key ^ (extra << np.uint64(24)), number, at), number, at)
        if len(begin):
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs[row[begin]]), pa.array(ths[row[begin]]), pa.array(at[begin].astype(np.int32)),
                 pa.array(stop.astype(np.int32))],
                ["doc", "th", "pos", "stop"],
            )

    now = None
    for batch in batches:
        groups = batch.column("part").to_numpy()
        for a in np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else []:
            b = a + int(np.searchsorted(groups[a:], groups[a], "right"))
            if held and groups[a] != now:
                yield from work(pa.Table.from_batches(held))
                held = []
            now = groups[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield from work(pa.Table.from_batches(held))


def duplicate_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """``(doc, th, spans)``: word positions ``[from, to, from, to, ...]`` of duplicate spans."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc"), text_hash(text_col).alias("th"), F.col(text_col).alias("text")
    )
    sent = rows.mapInArrow(lambda b: send_blocks(b, window, gram), SENT_SCHEMA)
    # Rows that carry a task's own factors go along, dealt by document.
    dealt = F.when(F.col("stop") >= 0, F.xxhash64("doc", "th", "pos")).otherwise(F.col("key"))
    found = (
        sent.withColumn("deal", dealt)
        .repartition("deal")
        .withColumn("part", F.pmod(F.xxhash64("deal"), F.lit(64)).cast("int"))
        .sortWithinPartitions("part", "doc", "th", "pos")
        .drop("deal")
        .mapInArrow(match_blocks, "doc long, th long, pos int, stop int")
    )
    return found.groupBy("doc", "th").agg(
        F.flatten(F.array_sort(F.collect_list(F.array(F.col("pos"), F.col("stop") + (window - 1))))).alias("spans")
    )


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the kept words, joined by one space, as text, and ``n_words``, ``n_removed``."""
    th, key, sd, sth, cut, n, m = fresh(docs, "_th", "_key", "_s_doc", "_s_th", "_spans", "n_words", "n_removed")
    spans = keep(spans.select(F.col("doc").alias(sd), F.col("th").alias(sth), F.col("spans").alias(cut)), "spans")
    rows = docs.withColumn(th, text_hash(text_col)).withColumn(
        key, F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST)))
    )
    joined = keyed_join(rows, spans, [(key, sd), (th, sth)], [key, th]).select(*docs.columns, cut)
    at = docs.columns.index(text_col)
    width = len(docs.columns)
    names = [*docs.columns, n, m]

    def run(batches):
        for batch in batches:
            texts, cuts, kept, counts, gone = batch.column(at), batch.column(width).to_pylist(), [], [], []
            for i, c in enumerate(cuts):
                words = split_words(texts[i].as_py())
                counts.append(len(words))
                if c:
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, c[::2], 1)
                    np.add.at(edge, c[1::2], -1)
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    gone.append(len(words) - len(stay))
                    words = [words[k] for k in stay]
                else:
                    gone.append(0)
                kept.append(b" ".join(words).decode())
            columns = [batch.column(k) for k in range(width)]
            columns[at] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names
            )

    schema = T.StructType([*docs.schema.fields, T.StructField(n, T.LongType()), T.StructField(m, T.LongType())])
    return joined.mapInArrow(run, schema)


def dedupe_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    return remove_spans(docs, duplicate_spans(docs, id_col, text_col, window, gram), id_col, text_col)
