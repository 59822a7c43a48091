"""Language-model scoring with a causal self-attention model on subword ids, trained in numpy.

Texts are lower-cased (A-Z) and cut into words at ASCII white space, and words into subwords by a public byte-level
vocabulary; a word's first subword has a space in front.  An end closes the text.  The model reads the sequence of all
subwords, and scores each once, given the ones before it: one layer of causal self-attention with a learnt distance bias predicts
the class of the next subword, and its share of the class is counted.  The most frequent subwords are a class each, the other
ones lie in bands, first subwords apart from those behind.

A word's probability is that of its first subword, times that of its rest, which is mixed of two: what attention gives to the
subwords behind and to the word's end, and the word's counted share of the words with this first subword, with add-0.1 smoothing.  So
words that are often seen go mostly by their counts, and rare and unknown ones by their subwords.  All counts cover the whole training text.

Training: one pass over all windows of the training texts, at every size, in a few rounds over distinct parts
of them.  A window holds all subwords of its words, and sees the subwords before it as they are, so that every subword of the training texts is a
target once, with the context that it has in scoring.  A round's windows are dealt over shards of about ``SHARD_WINDOWS``; Adam runs over each
shard in the order of its windows' numbers, and the shards' weights are averaged exactly.  Number and order of the shards follow from the texts alone, so
the model is the same on any cluster and after any lost task.  Scoring: blocks of ``STRIDE`` targets see the ``CONTEXT`` inputs up to
their own end, so windows overlap and every subword is scored once; blocks of many texts go through
masked attention together.

Beside the model's score stands a unigram base: add-0.1 smoothed word counts over all training texts.
The most frequent words, ``FREQUENT`` at most, are looked up in the tasks; the others are joined with the
whole table of counts, so every word gets its exact count.

Defined results: a null text counts as the empty one, which has the end alone; repeated rows are scored
alike; without training texts the counts are 0 and the model is untrained; columns beside id and text are
not looked at; the id is returned as it is, and the split goes by the caller's column.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwatch.llm.common import keep

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's pattern of words, which is a space and all up to the next one here.
PATTERN = r" [^ ]*"
CLASSES = 192
SINGLES = 160
DIM = 16
CONTEXT = 32
STRIDE = 16
#: Words whose counts each task holds, at most, and their bytes; the others are joined.
FREQUENT = 200_000
FREQUENT_BYTES = 64
WINDOW_WORDS = 64
#: The training windows are cut into so many parts; each is seen in one round.
ROUNDS = 4
#: Windows of a shard, about, in each round.
SHARD_WINDOWS = 8000
LEARNING_RATE = 0.01
BATCH = 64
SEED = 7
#: Share of the counts in the probability of a word's rest.
COUNTED = 0.98
#: Weights are averaged in this many parts of one.
SCALE = float(1 << 30)
#: Bytes of text that a task works on at once, unless one text has more.
CHUNK_BYTES = 1 << 22
#: Blocks whose attention is worked on at once, and targets whose class logits are, so that they stay in a core's cache.
BLOCKS = 128
TARGETS = 256
#: Classes that a window holds of the subwords before it: the inputs that its first block sees, and the one in front of its first target.
BEFORE = CONTEXT - STRIDE + 1
#: Words whose subwords a task remembers, or whose counts it sums.
CACHE = 400_000


def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of ``CHUNK_BYTES`` of its texts, or of a single longer text."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + CHUNK_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and all the words, one text after the other."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    sizes, words = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten()
    empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # white space at the ends of a text
        sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[empty], minlength=len(sizes))
        words = words.filter(pa.array(~empty))
    return sizes, words


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of ``values``, one after the other."""
    skipped = starts - (np.cumsum(sizes) - sizes)
    return values[np.arange(int(sizes.sum())) + np.repeat(skipped, sizes)]


class Leads:
    """Subwords of words, remembered."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoder = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.leading = leading_subwords(vocabulary)
        self.known: dict[str, int] = {}
        self.sizes, self.subwords = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many subwords each word has, and all of them, one word after the other.

        New words are cut together; of a word's subwords the first alone has a space, in front.
        """
        names, known = words.to_pylist(), self.known
        at = np.array([known.get(w, -1) for w in names], np.int64)
        new = np.flatnonzero(at < 0)
        own, subwords = self.sizes, self.subwords
        if len(new):
            found = np.array(self.encoder.encode_ordinary("".join([f" {names[i]}" for i in new.tolist()])), np.int64)
            more = np.diff(np.append(np.flatnonzero(self.leading[found]), len(found)))
            at[new] = len(own) + np.arange(len(new))
            room = max(0, CACHE - len(known))
            known.update(zip([names[i] for i in new[:room].tolist()], at[new[:room]].tolist()))
            self.sizes, self.subwords = np.append(own, more[:room]), np.append(subwords, found[: more[:room].sum()])
            own, subwords = np.append(own, more), np.append(subwords, found)
        sizes = own[at]
        return sizes, gathered(subwords, (np.cumsum(own) - own)[at], sizes)

    def of(self, words: pa.Array) -> np.ndarray:
        """The leading subword of each word."""
        sizes, subwords = self.pieces(words)
        return subwords[np.cumsum(sizes) - sizes]


_leads: dict[int, Leads] = {}


def leading_subwords(vocabulary: bytes) -> np.ndarray:
    """Which ids have a space in front."""
    ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, vocabulary.splitlines())}
    out = np.zeros(max(ranks) + 1, bool)
    out[[i for i, subword in ranks.items() if subword.startswith(b" ")]] = True
    return out


def leads_of(vocabulary: bytes) -> Leads:
    """One per Python worker."""
    key = hash(vocabulary)
    if key not in _leads:
        _leads[key] = Leads(vocabulary)
    return _leads[key]


def count_words(batches):
    """``(word, n)`` of a task, in parts of bounded size."""
    held, size = [], 0

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    for batch in batches:
        for part in chunks(batch):
            found = split_words(part.column("text"))[1].value_counts()
            held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
            size += len(found)
            if size > 2 * CACHE:
                held = [summed()]
                size = len(held[0])
                if size > CACHE:
                    yield from held[0].to_batches()
                    held, size = [], 0
    if size:
        yield from summed().to_batches()


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, n)`` over all rows of ``text``."""
    return texts.select("text").mapInArrow(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def with_pieces(counts: DataFrame, vocabulary: bytes) -> DataFrame:
    """``(word, n, pieces)``."""
    def run(batches):
        for batch in batches:
            sizes, subwords = leads_of(vocabulary).pieces(batch.column("word"))
            pieces = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(subwords, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pieces], ["word", "n", "pieces"])

    return counts.mapInArrow(run, "word string, n long, pieces array<int>")


@dataclass
class Counted:
    """Of each subword: its class, the natural logarithm of its share of the class, and that of what a word's count is divided by.

    The share goes by the subword's tokens n, with 0.1 added: ``(n + 0.1) / class``.  A word's count c gives its share
    ``(c + 0.1) / (N + 0.1 * (V + 1))`` of the tokens N and different words V that have its first subword.
    ``leading`` tells which classes are of first subwords, and the end's.
    """

    of: np.ndarray
    log: np.ndarray
    unit: np.ndarray
    leading: np.ndarray


def subword_counts(counts: DataFrame, vocabulary: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each subword, and the tokens and different words that it leads; at most one row per subword comes to the driver."""
    size = sum(1 for line in vocabulary.splitlines() if line.strip()) + 1
    out = np.zeros((3, size))
    rows = counts.select(F.explode("pieces").alias("id"), "n").groupBy("id").agg(F.sum("n").cast("double").alias("n")).toPandas()
    out[0, rows["id"]] = rows["n"]
    first = counts.groupBy(F.get("pieces", F.lit(0)).alias("id"))
    rows = first.agg(F.sum("n").cast("double").alias("n"), F.count("*").cast("double").alias("v")).toPandas()
    out[1, rows["id"]], out[2, rows["id"]] = rows["n"], rows["v"]
    return tuple(out)


@dataclass
class Frequent:
    """The most frequent words, each with its count and its subwords."""

    vocabulary: bytes
    words: pa.Array
    n: np.ndarray
    sizes: np.ndarray
    subwords: np.ndarray

    def look_up(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The different words, the place of each word among them, their counts or 0, how many subwords they have, and these."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        at = pc.fill_null(pc.index_in(distinct, value_set=self.words), -1).to_numpy()
        other = np.flatnonzero(at < 0)
        more, cut = leads_of(self.vocabulary).pieces(distinct.take(pa.array(other)))
        n, own = np.append(self.n, 0)[at], np.append(self.sizes, more)
        at = at.copy()
        at[other] = len(self.sizes) + np.arange(len(other))
        sizes = own[at]
        return distinct, coded.indices.to_numpy(), n, sizes, gathered(np.append(self.subwords, cut), (np.cumsum(own) - own)[at], sizes)


def sequences(sizes: np.ndarray, place: np.ndarray, of_word: np.ndarray, subwords: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The subwords of texts of ``sizes`` words, with ``end`` behind each text, where each word begins among them, and how long each text is.

    ``place`` is each word's place among the different ones, which have ``of_word`` of the ``subwords``.
    """
    n = of_word[place]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    out = np.full(int(n.sum()) + len(sizes), end)
    out[np.arange(int(n.sum())) + np.repeat(doc, n)] = gathered(subwords, (np.cumsum(of_word) - of_word)[place], n)
    return out, np.cumsum(n) - n + doc, np.bincount(doc, weights=n, minlength=len(sizes)).astype(np.int64) + 1


def classed(n: np.ndarray, leading: np.ndarray, led: np.ndarray, kinds: np.ndarray) -> Counted:
    """The most frequent subwords are a class each, the others are cut into bands of like mass, those that lead a word apart."""
    order = np.argsort(-n, kind="stable")
    of = np.zeros(len(n), np.int64)
    of[order[:SINGLES]] = np.arange(SINGLES)
    smooth = n + 0.1
    rest, at, bands = order[SINGLES:], SINGLES, CLASSES - SINGLES
    some = rest[leading[rest]]
    most = min(bands - 1, max(1, round(bands * smooth[some].sum() / smooth[rest].sum())))
    for ids, number in ((some, most), (rest[~leading[rest]], bands - most)):
        mass = np.cumsum(smooth[ids])
        of[ids] = at + np.minimum((mass / mass[-1:] * number).astype(int), number - 1)
        at += number
    total = np.bincount(of, weights=smooth, minlength=CLASSES)
    return Counted(of, np.log(smooth / total[of]), np.log(led + 0.1 * (kinds + 1)), np.bincount(of[leading], minlength=CLASSES) > 0)


# The model.  Weights lie in one vector, so that they can be averaged.
SHAPES = {
    "E": (CLASSES, DIM), "Q": (DIM, DIM), "K": (DIM, DIM), "V": (DIM, DIM), "r": (CONTEXT,),
    "U": (DIM, CLASSES), "b": (CLASSES,),
}
N_WEIGHTS = sum(math.prod(s) for s in SHAPES.values())
#: Distance from each query of a block to each key, and which keys lie after the query.
_DISTANCE = (STRIDE + np.arange(STRIDE))[:, None] - np.arange(CONTEXT)[None, :]
_AFTER = np.where(_DISTANCE < 0, np.float32(-1e9), np.float32(0))
_DISTANCE = np.maximum(_DISTANCE, 0)
_ONES = np.ones(CLASSES, np.float32)
_LEAST = np.float32(1e-30)


def parts(weights: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = math.prod(shape)
        out[name] = weights[at : at + n].reshape(shape)
        at += n
    return out


def first_weights(class_n: np.ndarray) -> np.ndarray:
    w = np.random.default_rng(SEED).normal(0, 0.15, N_WEIGHTS).astype(np.float32)
    p = parts(w)
    p["r"][:] = 0
    p["b"][:] = np.log((class_n + 1) / (class_n + 1).sum())
    p["U"] *= 0.3
    return w


def exponentials(z: np.ndarray, most: float):
    """Exponentials in place; where a value is large, all are taken less their row's maximum, which is returned.

    No value is above ``most``.
    """
    top = None
    if most > 60 and z.max() > 60:
        top = z.max(axis=-1, keepdims=True)
        z -= top
    np.exp(z, out=z)
    return np.float32(0) if top is None else top[..., 0]


def longest(rows: np.ndarray) -> float:
    return math.sqrt((rows * rows).sum(axis=1).max())


class Tables:
    """What the weights give for each class: an input's query, key and value go by its class alone.

    Values have a column of ones behind them, as outputs have before they meet ``u``.
    """

    def __init__(self, p: dict):
        scale = np.float32(1 / math.sqrt(DIM))
        ones = np.ones((CLASSES, 1), p["E"].dtype)
        self.e, self.projections = p["E"], np.concatenate([p["Q"] * scale, p["K"], p["V"]], axis=1)
        q, k, v = np.split(self.e @ self.projections, 3, axis=1)
        self.q, self.k, self.v = np.ascontiguousarray(q), np.ascontiguousarray(k), np.append(v, ones, axis=1)
        self.bias = p["r"][_DISTANCE] + _AFTER
        self.u, self.back = np.append(p["U"], p["b"][None], axis=0), np.append(p["U"].T, ones, axis=1)
        # Behind the classes' outputs stands that of no target.
        self.ut = np.append(p["U"].T, np.zeros((1, DIM), p["E"].dtype), axis=0)
        # Bounds of the attention's logits and of those of the classes.
        self.most_seen = longest(q) * longest(k) + p["r"].max()
        self.most = (longest(self.e) + longest(v)) * longest(p["U"].T) + p["b"].max()
        self.z = np.empty((TARGETS, CLASSES), self.e.dtype)

    def logits(self, h: np.ndarray):
        """Logits of the classes, in a place that the next call takes again."""
        return np.matmul(h, self.u, out=self.z[: len(h)])


def forward(t: Tables, x: np.ndarray, first: np.ndarray):
    """``x``: input classes, blocks x CONTEXT; ``first``: blocks without inputs before them."""
    own = np.ascontiguousarray(x[:, STRIDE:])
    q, k, v = t.q.take(own, axis=0), t.k.take(x, axis=0), t.v.take(x, axis=0)
    s = q @ k.transpose(0, 2, 1)
    s += t.bias
    s[first, :, : CONTEXT - STRIDE] = -1e9
    exponentials(s, t.most_seen)
    seen = s @ v
    seen /= np.maximum(seen[..., DIM:], _LEAST)
    h = np.ones_like(seen)
    np.add(t.e.take(own, axis=0), seen[..., :DIM], out=h[..., :DIM])
    return own, q, k, v, s, seen, h.reshape(-1, DIM + 1)


def log_probabilities(p: dict, x: np.ndarray, first: np.ndarray, y: np.ndarray, some: np.ndarray | None = None):
    """Natural logarithm of the probability of each target class; ``y``: blocks x STRIDE.  Given ``some`` classes, also that of these together."""
    t, out, rows = Tables(p), np.empty((1 if some is None else 2, *y.shape), p["E"].dtype), np.arange(TARGETS)
    sums = np.stack([_ONES] if some is None else [_ONES, some.astype(np.float32)], axis=1)
    for a in range(0, len(x), BLOCKS):
        h = forward(t, x[a : a + BLOCKS], first[a : a + BLOCKS])[-1]
        own, logs = y[a : a + BLOCKS].ravel(), out[:, a : a + BLOCKS].reshape(len(out), -1)
        for at in range(0, len(h), TARGETS):
            part = slice(at, at + TARGETS)
            z = t.logits(h[part])
            picked = z[rows[: len(z)], own[part]]
            top = exponentials(z, t.most)
            total = np.log(np.maximum(z @ sums, _LEAST))
            logs[0, part] = picked - top - total[:, 0]
            if some is not None:
                logs[1, part] = total[:, 1] - total[:, 0]
        out[:, a : a + BLOCKS] = logs.reshape(len(out), -1, STRIDE)
    return out[0] if some is None else (out[0], out[1])


def gradient(p: dict, x, first, y, valid) -> np.ndarray:
    """Gradient of the mean loss over the valid targets; the blocks of a text lie one after the other."""
    t, kind = Tables(p), p["E"].dtype
    de, dp = np.zeros(CLASSES * DIM), np.zeros((DIM, 3 * DIM), kind)
    dr, du = np.zeros((STRIDE, CONTEXT), kind), np.zeros((DIM + 1, CLASSES), kind)
    # Slices of whole texts.
    starts = np.flatnonzero(first)
    a = 0
    while a < len(x):
        more = np.searchsorted(starts, a + BLOCKS)
        b = int(starts[more]) if more < len(starts) else len(x)
        add_gradient(t, x[a:b], first[a:b], y[a:b].ravel(), valid[a:b].ravel(), de, dp, dr, du)
        a = b
    dq, dk, dv = np.split(dp, 3, axis=1)
    g = {
        "E": de, "Q": dq * np.float32(1 / math.sqrt(DIM)), "K": dk, "V": dv,
        "r": np.bincount(_DISTANCE.ravel(), weights=(dr * (_AFTER == 0)).ravel(), minlength=CONTEXT),
        "U": du[:DIM], "b": du[DIM],
    }
    return (np.concatenate([g[n].ravel() for n in SHAPES]) / max(1, valid.sum())).astype(np.float32)


def add_gradient(t: Tables, x, first, y, valid, de, dp, dr, du) -> None:
    """Adds what some texts' targets give together to the gradients of inputs, projections, distances and outputs."""
    own, q, k, v, s, seen, h = forward(t, x, first)
    dh, rows, asked = np.empty((len(h), DIM), h.dtype), np.arange(TARGETS), np.where(valid, y, CLASSES)
    for at in range(0, len(h), TARGETS):
        part = slice(at, at + TARGETS)
        z = t.logits(h[part])
        exponentials(z, t.most)
        mean = z @ t.back
        total = np.maximum(mean[:, DIM], _LEAST)
        z[rows[: len(z)], y[part]] -= total
        weight = (valid[part] / total).astype(h.dtype)[:, None]
        du += (h[part] * weight).T @ z
        np.multiply(mean[:, :DIM], weight, out=dh[part])
        dh[part] -= t.ut.take(asked[part], axis=0)
    total = np.maximum(s.reshape(-1, CONTEXT) @ _ONES[:CONTEXT], _LEAST).reshape(-1, STRIDE, 1)
    d = np.empty_like(seen)
    each = dh.reshape(-1, STRIDE, DIM) / total
    d[..., :DIM] = each
    np.negative(np.vecdot(each, seen[..., :DIM]), out=d[..., DIM])
    ds = d @ v.transpose(0, 2, 1)
    ds *= s
    dr += ds.sum(axis=0)
    # What each input gets as query, key and value.  A block's earlier inputs are the last block's own ones.
    got = [ds @ k]
    for one in (ds.transpose(0, 2, 1) @ q, s.transpose(0, 2, 1) @ each):
        one[:-1, STRIDE:] += one[1:, :STRIDE]
        got.append(one[:, STRIDE:])
    own = own.ravel()
    inputs = t.e.take(own, axis=0).T
    for i, one in enumerate(got):
        at, one = slice(i * DIM, (i + 1) * DIM), one.reshape(-1, DIM)
        dp[:, at] += inputs @ one
        dh += one @ t.projections[:, at].T
    cells = np.arange(CLASSES * DIM).reshape(CLASSES, DIM).take(own, axis=0)
    de += np.bincount(cells.ravel(), weights=dh.ravel(), minlength=CLASSES * DIM)


def blocks(sizes: np.ndarray):
    """Blocks of texts that lie one after the other with ``sizes`` targets each.

    Returns the place of each block's inputs (before the text: the text's first), whether a block is its
    text's first, the places of its targets and which of them are valid.
    """
    n = -(-sizes // STRIDE)
    base = np.repeat(np.cumsum(sizes) - sizes, n)
    end = np.repeat(np.cumsum(sizes), n)
    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = base + j * STRIDE
    targets = at[:, None] + np.arange(STRIDE)
    valid = targets < end[:, None]
    inputs = np.clip(at[:, None] + np.arange(STRIDE - CONTEXT, STRIDE), base[:, None], end[:, None] - 1)
    return inputs, j == 0, np.minimum(targets, end[:, None] - 1), valid


def training_windows(batches, frequent: Frequent, of: np.ndarray):
    """Class sequences of all windows of words, and a number that deals them over rounds and tasks.

    A window holds all subwords of its words.  ``before`` is how many classes of the subwords before a window stand in front of its own: ``BEFORE``,
    or none where a text begins.

    The number goes by id, words and place, so copies of a text are dealt apart.
    """
    import xxhash

    for batch in batches:
        for part in chunks(batch):
            sizes, words = split_words(part.column("text"))
            _, place, _, of_word, subwords = frequent.look_up(words)
            classes, begin, lengths = sequences(sizes, place, of_word, subwords, len(of) - 1)
            classes = of[classes].astype(np.int16)
            n = np.maximum(1, -(-sizes // WINDOW_WORDS))
            text = np.repeat(np.arange(len(sizes)), n)
            at = (np.arange(len(text)) - (np.cumsum(n) - n)[text]) * WINDOW_WORDS
            start = (np.cumsum(sizes) - sizes)[text] + at
            own = pc.binary_join(
                pa.ListArray.from_arrays(pa.array(np.append(start, len(place)), pa.int32()), words.cast(pa.binary())), b" "
            ).to_pylist()
            ids = [(i or "").encode("utf-8", "replace") for i in part.column("id").to_pylist()]
            deal = [
                xxhash.xxh64_intdigest(ids[i] + b" " + w if filled else ids[i], a) >> 1
                for i, w, filled, a in zip(text.tolist(), own, (sizes > 0)[text].tolist(), at.tolist())
            ]
            # A window begins where its first word does, or at the text's end, and ends where the next one begins.
            ends = np.cumsum(lengths)
            cuts = np.append(np.append(begin, 0)[start], len(classes))
            empty = np.flatnonzero((sizes == 0)[text])
            cuts[empty] = ends[text[empty]] - 1
            before = np.where(at > 0, BEFORE, 0)
            held = np.diff(cuts) + before
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)), pa.int32()), pa.array(gathered(classes, cuts[:-1] - before, held))),
                    pa.array(before, pa.int32()), pa.array(deal, pa.int64()),
                ],
                ["classes", "before", "deal"],
            )


class Training:
    """Adam over the windows of one shard, ``BATCH`` of them a step, from the given weights."""

    def __init__(self, weights: np.ndarray, end_class: int, rate: float):
        self.w, self.end_class, self.rate = weights.copy(), end_class, rate
        self.m, self.s, self.steps, self.n = np.zeros_like(weights), np.zeros_like(weights), 0, 0
        self.sizes, self.y, self.before = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def feed(self, sizes: np.ndarray, y: np.ndarray, before: np.ndarray | None = None) -> None:
        """More windows, of ``sizes`` classes with those ``before`` the windows' own; those that do not fill a step wait."""
        before = np.append(self.before, np.zeros(len(sizes), np.int64) if before is None else before)
        sizes, y = np.append(self.sizes, sizes), np.append(self.y, y)
        ends = np.append(0, np.cumsum(sizes))
        full = len(sizes) // BATCH * BATCH
        for at in range(0, full, BATCH):
            self.step(sizes[at : at + BATCH], y[ends[at] : ends[at + BATCH]], before[at : at + BATCH])
        self.sizes, self.y, self.before = sizes[full:], y[ends[full] :], before[full:]

    def step(self, sizes: np.ndarray, y: np.ndarray, before: np.ndarray) -> None:
        x = np.append(self.end_class, y[:-1])
        starts = np.cumsum(sizes) - sizes
        x[starts] = self.end_class
        # The first class before a window is an input alone, the others fill a block without targets.
        after = before > 0
        stays = np.ones(len(y), bool)
        stays[starts[after]] = False
        x, y, sizes = x[stays], y[stays], sizes - after
        inputs, first, targets, valid = blocks(sizes)
        valid[np.flatnonzero(first)[after]] = False
        g = gradient(parts(self.w), x[inputs], first, y[targets], valid)
        self.steps += 1
        self.n += int(valid.sum())
        self.m = 0.9 * self.m + 0.1 * g
        self.s = 0.99 * self.s + 0.01 * g * g
        up = self.m / (1 - 0.9**self.steps)
        self.w -= np.float32(self.rate) * up / (np.sqrt(self.s / (1 - 0.99**self.steps)) + 1e-6)

    def result(self) -> tuple[list, int]:
        if len(self.sizes):
            self.step(self.sizes, self.y, self.before)
        return self.w.tolist(), self.n


def train_task(batches, weights: np.ndarray, end_class: int, rate: float):
    """One row with the new weights per shard; rows come by shard, in order."""
    now, training = None, None

    def done():
        w, n = training.result()
        return pa.RecordBatch.from_arrays([pa.array([w], pa.list_(pa.float32())), pa.array([n])], ["w", "n"])

    for batch in batches:
        shards = batch.column("shard").to_numpy()
        sizes = batch.column("classes").value_lengths().to_numpy().astype(np.int64)
        classes = batch.column("classes").flatten().to_numpy()
        before = batch.column("before").to_numpy()
        ends = np.append(0, np.cumsum(sizes))
        cuts = np.flatnonzero(np.diff(shards)) + 1
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(shards))):
            if a == b:
                continue
            if shards[a] != now:
                if training is not None:
                    yield done()
                now, training = shards[a], Training(weights, end_class, rate)
            training.feed(sizes[a:b], classes[ends[a] : ends[b]], before[a:b])
    if training is not None:
        yield done()


def train(texts: DataFrame, frequent: Broadcast, found: Counted, class_n: np.ndarray) -> np.ndarray:
    """Weights of the attention model."""
    spark = texts.sparkSession
    of = found.of
    windows = keep(
        texts.select(F.col("doc_id").cast("string").alias("id"), "text")
        .mapInArrow(lambda b: training_windows(b, frequent.value, of), "classes array<smallint>, before int, deal long"),
        "windows",
    )
    n = windows.count()
    shards = max(1, n // ROUNDS // SHARD_WINDOWS)
    weights = first_weights(class_n)
    end_class = int(of[-1])
    for k in range(ROUNDS if n else 0):
        shared = spark.sparkContext.broadcast(weights)
        speed = LEARNING_RATE * 0.6**k
        part = windows.filter(F.pmod(F.col("deal"), F.lit(ROUNDS)) == k).withColumn(
            "shard", F.pmod(F.expr(f"deal div {ROUNDS}"), F.lit(shards)).cast("long")
        )
        # More partitions than shards, so that few of them hold two.
        rows = part.repartition(4 * shards, "shard").sortWithinPartitions("shard", "deal", "classes", "before").mapInArrow(
            lambda b, s=shared, v=speed: train_task(b, s.value, end_class, v), "w array<float>, n long"
        )
        mean = (
            rows.select(F.posexplode("w").alias("i", "x"), "n")
            .groupBy("i")
            # Whole numbers, whose sum does not depend on its order.
            .agg((F.sum(F.round(F.col("x").cast("double") * SCALE).cast("decimal(38,0)") * F.col("n")).cast("double") / SCALE / F.sum("n")).alias("x"))
            .toPandas()
        )
        if len(mean):  # a part of a small corpus can be empty
            weights = np.zeros(N_WEIGHTS, np.float32)
            weights[mean["i"]] = mean["x"]
    return weights


@dataclass
class Scorer:
    counted: Counted
    weights: np.ndarray

    def texts(self, texts: pa.Array, frequent: Frequent) -> list[pa.Array]:
        """Of each text: its tokens, known tokens, base over the counted words, score without the other words' rests, and the other words."""
        sizes, words = split_words(texts)
        distinct, place, n, of_word, subwords = frequent.look_up(words)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        base = np.bincount(doc, weights=np.where(n > 0, np.log10(n + 0.1), 0)[place], minlength=len(sizes)).astype(float)
        known = np.bincount(doc, weights=(n > 0)[place], minlength=len(sizes)).astype(np.int64)
        y, begin, lengths = sequences(sizes, place, of_word, subwords, len(self.counted.of) - 1)
        c = self.counted.of[y]
        x = np.append(0, c[:-1])
        ends = np.cumsum(lengths)
        x[ends - lengths] = self.counted.of[-1]
        inputs, first, targets, valid = blocks(lengths)
        p, logs, starts = parts(self.weights), self.counted.log[y], np.empty(len(y))
        for at in range(0, len(inputs), 512):
            part = slice(at, at + 512)
            own, led = log_probabilities(p, x[inputs[part]], first[part], c[targets[part]], self.counted.leading)
            logs[targets[part][valid[part]]] += own[valid[part]]
            starts[targets[part][valid[part]]] = led[valid[part]]
        # Words' first subwords and the ends, given that a word has ended; then what is behind the first subword, and the word's end.
        score = np.bincount(doc, weights=(logs - starts)[begin], minlength=len(sizes)) + (logs - starts)[ends - 1]
        behind = begin + of_word[place]
        upto = np.cumsum(logs)
        rest = upto[behind - 1] - upto[begin] + starts[behind]
        unit = self.counted.unit[subwords[np.cumsum(of_word) - of_word]]
        counted = (np.log(n + 0.1) - unit + math.log(COUNTED))[place]
        seen = (n > 0)[place]
        score += np.bincount(doc, weights=np.where(seen, np.logaddexp(counted, rest + math.log(1 - COUNTED)), 0), minlength=len(sizes))
        # The other words wait for their counts, each with the rests of all its places in the text.
        other = np.flatnonzero(~seen)
        other = other[np.argsort(doc[other] * len(distinct) + place[other], kind="stable")]
        both, tf = np.unique(doc[other] * len(distinct) + place[other], return_counts=True)
        of, word = np.divmod(both, max(1, len(distinct)))
        waiting = pa.StructArray.from_arrays(
            [
                distinct.take(pa.array(word)), pa.array(tf, pa.int64()), pa.array(unit[word]),
                pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tf)), pa.int32()), pa.array(rest[other])),
            ],
            ["word", "tf", "unit", "rests"],
        )
        waiting = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(sizes) + 1)), pa.int32()), waiting)
        return [pa.array(sizes + 1), pa.array(known), pa.array(base), pa.array(score / math.log(10)), waiting]


def score_rows(batches, scorer: Scorer, frequent: Frequent):
    for batch in batches:
        for part in chunks(batch):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *scorer.texts(part.column("text"), frequent)],
                ["doc_id", "held_out", "n_tokens", "known", "base", "score", "rest"],
            )


def frequent(counts: DataFrame, vocabulary: bytes, most: int = FREQUENT) -> Frequent:
    """The most frequent words, ``most`` of them at most, without very long ones."""
    counts = counts.filter(F.octet_length("word") <= FREQUENT_BYTES)
    band = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    sizes = counts.groupBy(band.alias("band")).agg(F.count("*").alias("words")).orderBy(F.desc("band")).collect()
    least, n = None, 0
    for row in sizes:
        n += row["words"]
        if n > most:
            break
        least = row["band"]
    rows = counts.filter(F.lit(False) if least is None else band >= least).select("word", "n", "pieces").toArrow().combine_chunks()
    pieces = rows.column("pieces").combine_chunks()
    return Frequent(
        vocabulary, rows.column("word").combine_chunks().cast(pa.string()), rows.column("n").to_numpy().astype(np.float64),
        pieces.value_lengths().to_numpy().astype(np.int64), pieces.flatten().to_numpy().astype(np.int64),
    )


def score(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    Scores are log10 probabilities; the model learns from the rows where ``held_out`` is false.
    ``vocabulary`` is a file of the driver, at most a few MB.
    """
    spark = docs.sparkSession
    names = Path(vocabulary).read_bytes()
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    learnt = rows.filter(~F.col("held_out"))
    counts = keep(with_pieces(word_counts(learnt), names), "words")
    n_words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_texts = learnt.select("held_out").count()
    tokens, kinds = n_words + n_texts, distinct + (1 if n_texts else 0)
    n, led, leads = subword_counts(counts, names)
    n[-1] = n_texts
    found = classed(n, np.append(leading_subwords(names), True), led, leads)
    class_n = np.bincount(found.of, weights=n, minlength=CLASSES)
    most = spark.sparkContext.broadcast(frequent(counts, names))
    scorer = spark.sparkContext.broadcast(Scorer(found, train(learnt, most, found, class_n)))
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType()),
        T.StructField("rest", T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("tf", T.LongType()),
            T.StructField("unit", T.DoubleType()), T.StructField("rests", T.ArrayType(T.DoubleType()))]))),
    ])
    # Written once, so that a row keeps its number.
    scored = keep(
        rows.mapInArrow(lambda b: score_rows(b, scorer.value, most.value), schema).withColumn("row", F.monotonically_increasing_id()), "scored"
    )
    share = COUNTED * (F.coalesce("n", F.lit(0)) + 0.1) / F.exp("unit")
    others = (
        scored.select("row", F.explode("rest").alias("x"))
        .select("row", "x.*")
        .join(counts.select("word", "n"), "word", "left")
        .withColumn("own", F.aggregate("rests", F.lit(0.0), lambda t, rest: t + F.log10(share + (1 - COUNTED) * F.exp(rest))))
        .groupBy("row")
        .agg(
            F.sum("own").alias("own"),
            F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("more"),
            F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("more_known"),
        )
    )
    end = math.log10(n_texts + 0.1)
    unit = math.log10(tokens + 0.1 * (kinds + 1))
    # The sum of log10(c + 0.1) over all tokens.
    common = F.col("base") + F.coalesce("more", F.lit(0.0)) + end
    return scored.join(others, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + (1 if n_texts else 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (common - F.col("n_tokens") * unit).alias("base_score"), (F.col("score") + F.coalesce("own", F.lit(0.0))).alias("score"),
    )
