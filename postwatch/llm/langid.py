"""Language identification: scripts, letter trigrams per word, and a Viterbi path over the words.

Training counts hashed letter trigrams per label, and which scripts a label's words use.  A word's candidates are the
labels that are written in its script; it is scored under these alone.  The best path through the words, at a price
for every change of label, cuts a mixed text into spans.  The label with most letters names the text,
and the score is its share of the letters.

A trigram's probability mixes its share under the label with its share over all labels.  So a trigram that a label has
never seen costs the same under every label, and one with little text takes no unknown words from the others.

Defined results: a null text and a text without letters give ``und``, score 0 and no spans; without any
labelled row everything is ``und``; a word in a script that no label uses scores alike under all of them;
of labels with equally many letters the first in the order of code points wins.  A text is labelled in
stretches of ``STRETCH`` code points, so the longest text needs no more memory than others; all of it
is labelled.  Columns of the input keep their names, and a result whose name is taken gets an underscore.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwatch.llm.common import fresh

BUCKETS = 1 << 15
#: Price of a change of label, in the unit of the scores, natural logarithms.
SWITCH = 8.0
#: Expected number of labelled texts to learn from; all of them where there are fewer.  Labels share it: those with few
#: texts give all of them, the others equally many, ``LABEL_DOCS`` at least.
SAMPLE_DOCS = 20_000
LABEL_DOCS = 100
#: A label is a candidate for a script in which this share of its letters is written.
SCRIPT_SHARE = 0.01
STRETCH = 1 << 16
#: Code points worked on at once, unless one text has more.
BLOCK = 1 << 20
#: Rows of a batch that are unpacked at once.
ROWS = 2000
NO_LABEL = "und"
#: Share of the distribution over all labels in each label's own, and letters that a label's counts are measured against:
#: what fewer letters say counts for less.
BACKGROUND = 0.03
LETTERS = 1000
#: Score of a label that is no candidate.
NEVER = -1e9

#: First and last code points of scripts (Unicode blocks).
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0x20000, 0x323AF),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: the lower-case letter (0: no letter), and its script."""
    top = 0x20000
    lower = np.zeros(0x110000, np.uint32)
    for c in range(top):
        if (x := chr(c)).isalpha():
            low = x.lower()
            lower[c] = ord(low) if len(low) == 1 else c
    lower[top:0x323B0] = np.arange(top, 0x323B0)
    script = np.zeros(0x110000, np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = SCRIPT_NAMES.index(name)
    return lower, script


@dataclass
class Words:
    """The words of several pieces of text, one after the other."""

    piece: np.ndarray  # of each word
    start: np.ndarray  # code points from the piece's start
    end: np.ndarray
    script: np.ndarray
    first: np.ndarray  # place of each word's first trigram
    trigrams: np.ndarray


def cut(pieces: list[str]) -> Words:
    """Words are runs of letters; a word has a trigram around each of its letters, lower-cased."""
    lower, script = _tables()
    points = [np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32) for p in pieces]
    sizes = np.fromiter(map(len, points), np.int64, len(points)) + 1
    bases = np.cumsum(sizes) - sizes
    raw = np.zeros(int(sizes.sum()) + 1, np.uint32)
    for p, at in zip(points, bases):
        raw[at + 1 : at + 1 + len(p)] = p  # a gap before each piece and after the last
    low = lower[raw]
    is_letter = low > 0
    at = np.flatnonzero(is_letter)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none, none, none)
    a, b, c = low[at - 1], low[at], low[at + 1]
    h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    trigrams = (h >> np.uint32(17)).astype(np.int64)
    first = np.flatnonzero(~is_letter[at - 1])
    begin = at[first]
    last = at[np.append(first[1:], len(at)) - 1]
    piece = np.searchsorted(bases, begin, "right") - 1
    return Words(
        piece, begin - bases[piece] - 1, last - bases[piece], script[raw[begin]], first, trigrams
    )


@dataclass
class Model:
    labels: list[str]
    logs: np.ndarray  # BUCKETS x labels
    candidates: np.ndarray  # scripts x labels, whether a word in the script may be of the label


def counts(batches, label: str, text: str):
    """Per task: ``(label, bucket, n)`` of trigrams; scripts are counted as buckets from BUCKETS on."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        labels, texts = batch.column(label).to_pylist(), batch.column(text)
        for i, name in enumerate(labels):
            whole = texts[i].as_py() or ""
            for at in range(0, len(whole), BLOCK):
                w = cut([whole[at : at + BLOCK]])
                if name not in total:
                    total[name] = np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64)
                total[name][:BUCKETS] += np.bincount(w.trigrams, minlength=BUCKETS)
                total[name][BUCKETS:] += np.bincount(
                    w.script, weights=w.end - w.start, minlength=len(SCRIPT_NAMES)
                ).astype(np.int64)
    for name, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["label", "bucket", "n"]
        )


def even_share(sizes: list[int], total: int, least: int = LABEL_DOCS) -> int:
    """The bound for each size at which the bounded sizes make ``total`` together, ``least`` at the smallest."""
    left, share = total, 0
    for i, n in enumerate(sorted(sizes)):
        share = left // (len(sizes) - i)
        if n > share:
            break
        left -= n
        share = n
    return max(share, least)


def fit(
    labelled: DataFrame,
    label_col: str = "lang",
    text_col: str = "text",
    by: Column | None = None,
    sample_docs: int = SAMPLE_DOCS,
) -> Model:
    """Learn from the rows of ``labelled`` with a label and a text.

    About ``sample_docs`` texts are used, of each label those with the smallest hashes of ``by`` (of the text, if not
    given), at least one; all texts where there are fewer.  The model has one column per label, and what comes to
    the driver is one number per label and bucket.
    """
    rows = labelled.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"),
        F.xxhash64(F.col(text_col) if by is None else by).alias("h"),
    )
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()  # a row per label
    if sum(r["n"] for r in sizes) > sample_docs:
        most = even_share([r["n"] for r in sizes], sample_docs)
        bounds = [(r["label"], max(r["least"], int(most / r["n"] * 2.0**64 - 2.0**63))) for r in sizes if r["n"] > most]
        if bounds:
            given = labelled.sparkSession.createDataFrame(bounds, "of string, bound long")
            rows = rows.join(F.broadcast(given), F.col("label") == F.col("of"), "left").filter("bound IS NULL OR h <= bound")
    found = (
        rows.select("label", "text")
        .mapInArrow(lambda batches: counts(batches, "label", "text"), "label string, bucket int, n long")
        .groupBy("label", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    labels = sorted(found["label"].unique().tolist())
    n = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(labels)))
    n[found["bucket"], np.searchsorted(labels, found["label"])] = found["n"]
    return model_of(labels, n[:BUCKETS], n[BUCKETS:])


def model_of(labels: list[str], grams: np.ndarray, letters: np.ndarray) -> Model:
    """The model of counted trigrams and of counted letters by script, a column per label."""
    every = (grams.sum(axis=1, keepdims=True) + 1) / (grams.sum() + len(grams))
    own = grams / (grams.sum(axis=0) + LETTERS)
    logs = np.log((1 - BACKGROUND) * own + BACKGROUND * every).astype(np.float32)
    candidates = letters / np.maximum(letters.sum(axis=0), 1) >= SCRIPT_SHARE
    # A script that no label is written in.
    candidates[~candidates.any(axis=1)] = True
    return Model(labels, logs, candidates)


def word_scores(w: Words, model: Model) -> np.ndarray:
    """Log likelihood of each word under each of its candidates; ``NEVER`` under the other labels."""
    n = len(w.first)
    s = np.full((n, len(model.labels)), NEVER, np.float32)
    sizes = np.diff(np.append(w.first, len(w.trigrams)))
    for k in range(len(model.labels)):
        own = model.candidates[w.script, k]
        if own.all():
            s[:, k] = np.add.reduceat(model.logs[:, k][w.trigrams], w.first)
        elif own.any():
            trigrams = w.trigrams[np.repeat(own, sizes)]
            s[own, k] = np.add.reduceat(model.logs[:, k][trigrams], np.cumsum(sizes[own]) - sizes[own])
    return s


def best_path(scores: np.ndarray, piece: np.ndarray, n_pieces: int, switch: float) -> np.ndarray:
    """Label of each word on the best path of its piece.  All pieces advance together, word by word."""
    size = np.bincount(piece, minlength=n_pieces)
    base = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    size, base = size[order], base[order]
    longest = int(size[0]) if n_pieces else 0
    label = np.zeros(len(scores), np.int16)
    kept = np.zeros(scores.shape, bool)  # whether the best way to a label stays with it
    came = np.zeros(len(scores), np.int16)  # else the label it changes from
    active = np.searchsorted(-size, -np.arange(longest), "left")  # pieces with a word at each step
    value = np.zeros((n_pieces, scores.shape[1]), np.float32)
    last = np.zeros(n_pieces, np.int16)
    for t in range(longest):
        m = active[t]
        v, at = value[:m], base[:m] + t
        if t:
            top = v.argmax(axis=1)
            change = v[np.arange(m), top] - switch
            kept[at] = v >= change[:, None]
            came[at] = top
            np.maximum(v, change[:, None], out=v)
        v += scores[at]
        v -= v.max(axis=1, keepdims=True)
    last = value.argmax(axis=1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at, now = base[:m] + t, last[:m]
        label[at] = now
        if t:
            last[:m] = np.where(kept[at, now], now, came[at])
    return label


def identify_texts(texts: list[str | None], model: Model, switch: float = SWITCH):
    """Of each text: label, score, spans ``(start, end, label)`` in code points."""
    pieces, owner, offset = [], [], []
    for i, text in enumerate(texts):
        for at in range(0, len(text or ""), STRETCH):
            pieces.append(text[at : at + STRETCH])
            owner.append(i)
            offset.append(at)
    w = cut(pieces)
    out = [(NO_LABEL, 0.0, []) for _ in texts]
    if not len(w.first) or not model.labels:
        return out
    label = best_path(word_scores(w, model), w.piece, len(pieces), switch)
    doc = np.array(owner)[w.piece]
    shift = np.array(offset)[w.piece]
    letters = np.zeros((len(texts), len(model.labels)))
    np.add.at(letters, (doc, label), w.end - w.start)
    best = letters.argmax(axis=1)
    total = letters.sum(axis=1)
    cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(label) != 0)) + 1
    firsts, lasts = np.append(0, cuts), np.append(cuts, len(doc)) - 1
    spans: list[list] = [[] for _ in texts]
    starts, ends = (w.start + shift)[firsts].tolist(), (w.end + shift)[lasts].tolist()
    for d, a, b, k in zip(doc[firsts].tolist(), starts, ends, label[firsts].tolist()):
        spans[d].append((a, b, model.labels[k]))
    for i in np.flatnonzero(total):
        out[i] = (model.labels[best[i]], float(letters[i, best[i]] / total[i]), spans[i])
    return out


SPANS = "array<struct<start:int,end:int,lang:string>>"


def identify(
    docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True, switch: float = SWITCH
) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``spans`` to the rows of ``docs``."""
    kept = [c for c in docs.columns if keep_text or c != text_col]
    results = fresh(docs.select(*kept), "lang_pred", "score", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one column per label, BUCKETS rows
    rows = docs.select(*kept, *([] if text_col in kept else [text_col]))
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        for batch in (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)):
            texts = batch.column(rows_at).to_pylist()
            order = sorted(range(len(texts)), key=lambda i: len(texts[i] or ""))
            found: list = [None] * len(texts)
            block, size = [], 0
            for i in [*order, None]:
                if block and (i is None or size + len(texts[i] or "") > BLOCK):
                    for k, x in zip(block, identify_texts([texts[k] for k in block], shared.value, switch)):
                        found[k] = x
                    block, size = [], 0
                if i is not None:
                    block.append(i)
                    size += len(texts[i] or "")
            spans = [[{"start": a, "end": b, "lang": c} for a, b, c in x[2]] for x in found]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(kept))), pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64()), pa.array(spans, span_type)],
                [*kept, *results],
            )

    rows_at = rows.columns.index(text_col)
    schema = T.StructType([
        *(rows.schema[c] for c in kept), T.StructField(results[0], T.StringType()),
        T.StructField(results[1], T.DoubleType()), T.StructField(results[2], T._parse_datatype_string(SPANS)),
    ])
    return rows.mapInArrow(run, schema)
