"""Packing: the plan against its rules, every id in one place, and odd rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postwatch.llm import packing, registry
from postwatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.public_tokenizer())


def gapless(parts):
    end = 0
    for start, size in sorted(parts):
        assert start == end
        end += size
    return end


def check(rows, docs, capacity=1024):
    """Each id of ``docs`` lies in one piece and each place of a sequence in one; gives the sizes of the sequences."""
    of, at = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = docs[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        of[r["doc_id"]].append((r["start"], r["length"]))
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {d: gapless(p) for d, p in of.items()} == {d: len(x) for d, x in docs.items()}
    sizes = [gapless(p) for p in at.values()]
    assert max(sizes, default=0) <= capacity
    return sizes


def test_query(spark, tokenizer):
    docs = {
        r["doc_id"]: np.asarray([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()
    }
    sizes = check(QUERIES["op11_packing"](spark, SF).collect(), docs)
    assert all(n & (n - 1) == 0 for n in sizes) and sum(n < 1024 for n in sizes) <= 10


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 64, 1024])
    kinds = 1 if seed % 3 == 0 else rng.randint(1, capacity)
    counts = {rng.randint(1, capacity): rng.randint(1, rng.choice([3, 500])) for _ in range(kinds)}
    sequences, pieces = defaultdict(list), defaultdict(list)
    for of, first, n, start, size, k, at, sequence, offset in packing.plan(counts, capacity):
        for j in range(n):
            sequences[sequence + (at + j) // k].append((offset + (at + j) % k * size, size))
            pieces[of, first + j].append((start, size))
    assert all(gapless(p) == of for (of, _), p in pieces.items()) and len(pieces) == sum(counts.values())
    assert sorted(sequences) == list(range(len(sequences)))
    sizes = [gapless(p) for p in sequences.values()]
    assert max(sizes) <= capacity and all(n == capacity or n & (n - 1) == 0 for n in sizes)
    assert sum(n < capacity for n in sizes) <= capacity.bit_length()


def test_plan_does_not_grow_with_the_pieces():
    rng = random.Random(0)
    shape = {n: rng.randint(1, 1000) for n in range(1, 1025)}
    rows = [len(packing.plan({n: c * k for n, c in shape.items()})) for k in (1, 1000, 1_000_000)]
    assert max(rows) <= 2 * min(rows) and max(rows) < 20_000


def test_fill_is_closest():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(rng.randint(0, 4))}
        room = rng.randint(0, 30)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        chosen = packing.fill(counts, room)
        assert all(0 < k <= counts[length] for length, k in chosen.items())
        assert sum(length * k for length, k in chosen.items()) == max(s for s in sums if s <= room)


def test_encoder(tokenizer):
    with open(packing.public_tokenizer(), encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    assert encoder.plain and encoder.ranked is not None
    rng = random.Random(2)
    parts = ["", " ", "  ", "\n", " \n ", "\t", "\x1c", "\xa0", "　", "it's", "we'LL", "é", "中文", "\U0001F600", "<|endoftext|>", "a1b2", "--", "x" * 300]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(encoder(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_odd_rows(spark, tokenizer):
    registry.ship(spark)
    long = " ".join(f"word{i}" for i in range(20_000))
    rows = [(1, None, 9), (2, "", 9), (None, "nameless", 9), (3, "same text", 9), (3, "same text", 9), (4, long, 9), (5, "<|endoftext|>", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").withColumn("sequence_id", F.lit("x"))
    out = packing.pack(docs, ids=True).cache()
    got = out.collect()
    ids = {d: np.asarray([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t, _ in rows}
    same = [r for r in got if r["doc_id"] == 3]
    assert sum(r["length"] for r in same) == 2 * len(ids[3])
    assert sum(r["length"] for r in got) == sum(len(ids[d]) for d, _, _ in rows)
    for r in got:
        width = len(r["ids"]) // r["length"]
        part = np.frombuffer(bytes(r["ids"]), f"<u{width}").astype("<u4")
        assert part.tolist() == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tolist()
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
    places = {(r["sequence_id"], r["offset"] + i) for r in got for i in range(r["length"])}
    assert len(places) == sum(r["length"] for r in got)
    sequences = packing.sequences(out).collect()
    assert sum(len(s["ids"]) for s in sequences) >= sum(r["length"] for r in got)
    assert all(len(s["ids"]) == 1024 or len(s["ids"]) & (len(s["ids"]) - 1) == 0 for s in sequences)
    by = {s["sequence_id"]: s["ids"] for s in sequences}
    for r in got:
        want = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tolist()
        assert by[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == want
    assert packing.pack(docs.limit(0)).collect() == []
