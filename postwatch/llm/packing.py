"""Packing of token ids into fixed windows by minimum bin slack.

Every text becomes its token ids and an end id.  A document longer than a window is cut into whole windows and
one rest, so a piece is described by its length alone, and the packing problem by the number of pieces of each
length: at most as many numbers as a window has places, whatever the number of documents.  On these counts
``plan`` chooses windows.  The longest remaining length opens a window; a subset-sum table over the other
lengths, a bit per sum, finds the multiset that fills it closest to the capacity, and backtracking through the
tables gives the counts.  One choice fills as many windows as the counts allow.  Where even the closest sum leaves
slack, one more piece is cut to fill it and its other part goes back to the counts.  What is left at the
end, less than one window, is laid out in windows whose sizes are powers of two, which need no padding.

Spark numbers the pieces of each length, and the plan says which numbers go where: a join with a table whose size
depends on the capacity alone.

- A null or empty text is one end id.  Texts of any length are encoded whole, a stretch between white space at a time.
- Rows that repeat are packed once each.  Ties of length go by document, place and then by row; rows that tie in all are alike.
- An empty table gives an empty result.  Only the id and the text are read; other columns, whatever their names, are not.
- A null id is kept and comes first among ties.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwatch.llm.common import keep, keyed_join
from postwatch.operators.ordinal import with_ordinal

CAPACITY = 1024
#: Goes behind each text.
END_ID = 0
#: Stretches that an encoder remembers; beyond, it forgets them all and goes on.
REMEMBERED = 1_000_000
#: Longer stretches are not remembered.
LONGEST = 64


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder(dict):
    """Ids of a text, as unsigned little-endian 32-bit numbers, by a byte-level BPE file of ``tokenizers``.

    No token of such a vocabulary goes on from a character into white space behind it, so the stretches ``white
    space, then other characters`` are encoded one by one and remembered.  Ids of these vocabularies are the
    ranks of the merges, which ``tiktoken`` applies several times faster; stretches with a special token in
    them, and files of another kind, go through ``tokenizers`` itself.
    """

    stretches = re.compile(r"\s*\S+|\s+").findall

    def __init__(self, file: str):
        super().__init__()
        import json

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(file)
        rules = json.loads(file)
        self.ids = self.whole.get_vocab_size(with_added_tokens=True)
        special = [t["content"] for t in rules["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))).search if special else lambda text: None
        pre = rules["pre_tokenizer"] or {}
        self.plain = (
            rules["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
            and rules["normalizer"] is None
        )
        self.ranked = self._ranked(rules) if self.plain else None

    @staticmethod
    def _ranked(rules):
        import tiktoken

        # Bytes that print stand for themselves, the others for the code points from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t["content"] for t in rules["added_tokens"]}
        ranks = {bytes(map(byte.get, w)): i for w, i in rules["model"]["vocab"].items() if w not in special}
        merged = [rules["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in rules["model"]["merges"]]
        if merged != sorted(merged):
            return None
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.ranked is None or self.special(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranked.encode_ordinary(text)
        return np.asarray(ids, "<u4").tobytes() if len(ids) > 64 else array("I", ids).tobytes()

    def __missing__(self, stretch: str) -> bytes:
        ids = self.encode(stretch)
        if len(stretch) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[stretch] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if not self.plain:
            return self.encode(text)
        return b"".join(map(self.__getitem__, self.stretches(text)))


#: One encoder per file and Python worker.
_encoders: dict[int, Encoder] = {}


def _encoder(file: str) -> Encoder:
    key = zlib.crc32(file.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(file)
    return _encoders[key]


def cut_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    capacity: int = CAPACITY, end_id: int = END_ID,
) -> DataFrame:
    """A stored row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, ids, row``.

    ``ids`` holds 2 bytes an id where all ids fit, else 4; ``row`` is unique.  The tokenizer's file is read on the
    driver and sent to the tasks.
    """
    with open(tokenizer or public_tokenizer(), encoding="utf-8") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("start", T.LongType()),
         T.StructField("length", T.IntegerType()), T.StructField("ids_crc32", T.LongType()),
         T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    )
    end = array("I", [end_id]).tobytes()

    def run(batches):
        encoder = _encoder(file.value)
        narrow = encoder.ids <= 1 << 16 and end_id < 1 << 16
        for batch in batches:
            of, starts, lengths, sums, sizes, held = [], [], [], [], [], []
            texts = batch.column(1)
            for i in range(batch.num_rows):
                ids = encoder(texts[i].as_py() or "") + end
                size = len(ids) // 4
                for at in range(0, size, capacity):
                    part = ids[4 * at : 4 * (at + capacity)]
                    of.append(i)
                    starts.append(at)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    sizes.append(size)
                    held.append(np.frombuffer(part, "<u4").astype("<u2").tobytes() if narrow else part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()),
                 pa.array(sums, pa.int64()), pa.array(sizes, pa.int64()), pa.array(held, pa.binary())],
                schema.names,
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return keep(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "pieces")


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most ``counts`` of each, whose sum comes closest to ``room`` from below.

    A bit per reachable sum.  The longest lengths are offered first and the backtracking takes as few of the later
    ones as it can, so short pieces are left for where they are needed.
    """
    sums, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        if sums >> room & 1:
            break
        left = min(counts[length], room // length)
        if left <= 0:
            continue
        steps.append((length, sums))
        k = 1
        while left:
            take = min(k, left)
            sums |= sums << length * take & mask
            left -= take
            k *= 2
    best, chosen = sums.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> best & 1:
            best -= length
            n += 1
        if n:
            chosen[length] = n
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    """Where the pieces of each length go.

    A row ``(length, first, n, start, size, k, at, sequence, offset)`` says: of the pieces of ``length`` those numbered
    ``first`` to ``first + n - 1`` give ``size`` ids from their place ``start`` on; counted from ``at``, ``k``
    of them in a row lie side by side in one sequence, from ``offset`` on, and the next ``k`` in the next one.
    """
    counts = defaultdict(int, {length: n for length, n in counts.items() if n})
    runs = {length: deque([(length, 0, n, 0)]) for length, n in counts.items()}
    rows, sequence = [], 0

    def take(length, n):
        counts[length] -= n
        queue = runs[length]
        while n:
            origin, first, there, start = queue.popleft()
            got = min(n, there)
            if got < there:
                queue.appendleft((origin, first + got, there - got, start))
            n -= got
            yield origin, first, got, start

    def put(length, n, k, offset):
        at = 0
        for origin, first, got, start in take(length, n):
            rows.append((origin, first, got, start, length, k, at, sequence, offset))
            at += got

    def cut(length, size, n, offset):
        at = 0
        for origin, first, got, start in list(take(length, n)):
            rows.append((origin, first, got, start, size, 1, at, sequence, offset))
            at += got
            runs.setdefault(length - size, deque()).append((origin, first, got, start + size))
            counts[length - size] += got

    while any(counts.values()):
        live = {length: n for length, n in counts.items() if n}
        longest = max(live)
        chosen = defaultdict(int, fill(live | {longest: live[longest] - 1}, capacity - longest))
        chosen[longest] += 1
        total = sum(length * k for length, k in chosen.items())
        others = [length for length, n in live.items() if n > chosen.get(length, 0)]
        if total < capacity and not others:
            break
        split = max(others) if total < capacity else None
        times = min(live[length] // (k + (length == split)) for length, k in (chosen | {split: chosen.get(split, 0)} if split else chosen).items())
        offset = 0
        for length, k in sorted(chosen.items(), reverse=True):
            put(length, k * times, k, offset)
            offset += length * k
        if split:
            cut(split, capacity - total, times, offset)
        sequence += times
    # Less than one window is left.
    left = sum(length * n for length, n in counts.items())
    for bit in reversed(range(left.bit_length())):
        room = (left & 1 << bit) and 1 << bit
        offset = 0
        while offset < room:
            length = max(length for length, n in counts.items() if n)
            if length <= room - offset:
                put(length, 1, 1, offset)
                offset += length
            else:
                cut(length, room - offset, 1, offset)
                offset = room
        sequence += bool(room)
    return rows


PLAN = "of int, first long, n long, at long, size int, k long, i long, opens long, place int"


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False,
) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, and the ``ids``, as binary, if wanted."""
    spark = docs.sparkSession
    pieces = cut_pieces(docs, id_col, text_col, tokenizer, capacity, end_id)
    placed = with_ordinal(pieces.drop("ids"), "length", "doc_id", "start", "row")
    # At most ``capacity`` numbers.
    counts = dict(placed.groupBy("length").count().collect())
    firsts, total = [], 0
    for length in sorted(counts):
        firsts.append((length, total))
        total += counts[length]
    where = spark.createDataFrame(plan(counts, capacity), PLAN)
    first = spark.createDataFrame(firsts, "of int, before long")
    where = where.join(F.broadcast(first), "of").withColumn("first", F.col("first") + F.col("before"))
    number = F.col("i") + F.col("ordinal") - F.col("first")
    found = placed.join(
        F.broadcast(where),
        (F.col("length") == F.col("of")) & (F.col("ordinal") >= F.col("first")) & (F.col("ordinal") < F.col("first") + F.col("n")),
    ).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "row", "at", "size",
        (F.col("opens") + F.floor(number / F.col("k"))).alias("sequence_id"),
        (F.col("place") + F.pmod(number, F.col("k")) * F.col("size")).alias("offset"),
    )
    whole, names = found.filter("size = length"), ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if ids:
        whole = whole.join(pieces.select("row", "ids"), "row")
    # A piece has less than ``capacity`` cuts.
    cuts = (
        found.filter("size < length").groupBy(F.col("row").alias("of_row"))
        .agg(F.collect_list(F.struct("at", "size", "sequence_id", "offset")).alias("cut"))
    )
    parts = (
        keyed_join(pieces, keep(cuts, "cuts"), [("row", "of_row")], ["row"], "inner", salts=1)
        .select("doc_id", "start", "length", "doc_tokens", "ids", F.explode("cut").alias("cut"))
        .select(
            "doc_id", (F.col("start") + F.col("cut.at")).alias("start"), F.col("cut.size").cast("long").alias("length"),
            F.expr("substring(ids, int(cut.at * (length(ids) / length) + 1), int(cut.size * (length(ids) / length)))").alias("ids"),
            "doc_tokens", "cut.sequence_id", "cut.offset",
        )
    )
    columns = [*names, *["ids"] * ids]
    whole = whole.withColumn("length", F.col("length").cast("long")).select(*columns)
    return whole.unionAll(parts.withColumn("ids_crc32", _crc32()).select(*columns))


def _crc32():
    """Of the ids as 32-bit numbers, from ``ids`` with ``length`` numbers of 2 or 4 bytes."""
    digits = F.hex("ids")
    wide = F.unhex(F.regexp_replace(digits, "(.{4})", "$10000"))
    return F.crc32(F.when(F.length("ids") == 4 * F.col("length"), F.col("ids")).otherwise(wide))


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = END_ID) -> DataFrame:
    """``(sequence_id, ids, doc_ids, offsets)``: whole sequences of what ``pack`` gives with ``ids=True``.

    A sequence shorter than ``capacity`` is padded, unless its length is a power of two.
    """
    def run(batches):
        for batch in batches:
            out = []
            for parts, lengths in zip(batch.column("parts").to_pylist(), batch.column("lengths").to_pylist()):
                ids = [np.frombuffer(p, "<u2" if len(p) == 2 * n else "<u4") for p, n in zip(parts, lengths)]
                row = np.concatenate(ids).astype(np.int32)
                if len(row) & (len(row) - 1):
                    row = np.pad(row, (0, capacity - len(row)), constant_values=pad_id)
                out.append(row)
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            values = np.concatenate(out) if out else np.zeros(0, np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            keepers = [batch.column(c) for c in ("sequence_id", "doc_ids", "offsets")]
            yield pa.RecordBatch.from_arrays([keepers[0], column, *keepers[1:]], ["sequence_id", "ids", "doc_ids", "offsets"])

    # A sequence has at most ``capacity`` pieces.
    rows = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("p")
    ).select(
        "sequence_id", F.col("p.ids").alias("parts"), F.col("p.length").alias("lengths"),
        F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"),
    )
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType(
        [T.StructField("sequence_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
         T.StructField("doc_ids", kinds["doc_ids"]), T.StructField("offsets", kinds["offsets"])]
    )
    return rows.mapInArrow(run, schema)
