"""The conversation trie against brute force, with bursts, long conversations and odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from postwatch.llm import registry, trie
from postwatch.llm.queries import QUERIES, rebuilt

SF = "/root/testdata/sf0.001"


def nodes(sequences):
    members, children = defaultdict(list), defaultdict(set)
    for conv, turns in sequences.items():
        for depth in range(len(turns) + 1):
            members[turns[:depth]].append(conv)
            if depth:
                children[turns[: depth - 1]].add(turns[:depth])
    leaves, saved, out = {}, {}, set()
    for at in sorted(members, key=len, reverse=True):
        leaves[at] = sum(leaves[c] for c in children[at]) or 1
        own = (len(members[at]) - 1) * len(at[-1][1]) if at else 0
        saved[at] = own + sum(saved[c] for c in children[at])
        ends = ",".join(str(c) for c in sorted(members[at]) if sequences[c] == at)
        above = min(members[at[:-1]]) if at else None
        out.add((min(members[at]), len(at), above, len(members[at]), len(children[at]), leaves[at], saved[at], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def sequences(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: tuple((r, t) for _, _, r, t in sorted(v)) for c, v in turns.items()}
    out = {}
    for conv, own in turns.items():
        n = zlib.crc32(str(conv).encode()) % 6
        out[conv] = turns.get(conv - conv % 100, ())[:n] + own[n:]
    return out


def rows_of(found):
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    return set(got)


def frame(spark, given):
    rows = [(c, i, role, text) for c, turns in given.items() for i, (role, text) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv long, at long, role string, text string")
    named = spark.createDataFrame([(c, -1, None, None) for c in given], "conv long, at long, key binary, size int")
    return turns.select("conv", "at", trie.turn_key(F.col("role"), F.col("text")).alias("key"), F.length("text").alias("size")).unionAll(named)


def test_query(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist()]
    assert rows_of(QUERIES["op13_prefix_trie"](spark, SF)) == nodes(sequences(rows))


@pytest.mark.parametrize("limit, held", [(1, 2), (4, 64), (2, 0), (10_000, 3)])
def test_bursts_and_tails(spark, limit, held):
    """A limit of 1 bursts whatever branches; with few held turns most nodes are tails."""
    registry.ship(spark)
    rng = random.Random(limit)
    given = {
        c: tuple((rng.choice("ab") if i < 4 else "a", "yy" if rng.random() < 0.15 else "x") for i in range(rng.choice([0, 1, 2, 3, 5, 9])))
        for c in range(-20, 80)
    }
    # Copies, and two long ones that part late.
    given |= {c: given[1] for c in range(200, 230)}
    given |= {300: (("u", "same"),) * 12, 301: (*((("u", "same"),) * 11), ("u", "other")), 302: (("u", "same"),) * 12}
    assert rows_of(trie.prefix_trie(frame(spark, given), "conv", ["at"], limit=limit, held=held)) == nodes(given)


def test_long_conversation(spark):
    registry.ship(spark)
    given = {1: tuple(("u", str(i)) for i in range(3000)), 2: (("u", "0"), ("u", "1")), 3: tuple(("u", str(i)) for i in range(100)) + (("a", "end"),)}
    found = trie.prefix_trie(frame(spark, given), "conv", ["at"])
    assert rows_of(found) == nodes(given)


def test_odd_rows(spark):
    registry.ship(spark)
    rng = random.Random(4)
    rows = [
        (rng.choice([None, 0, 1, 2, 3, 100, 101, 205]), rng.choice([None, 0, 1, 2]), rng.choice([None, "", "user"]), rng.choice([None, "", "x", "long " * 30_000]))
        for _ in range(40)
    ]
    rows += [(101, 1, "user", "x")] * 3
    given = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, key int, place string")
    assert rows_of(trie.prefix_trie(rebuilt(given), "conv", ["part", "place"])) == nodes(sequences(rows))
    assert trie.prefix_trie(rebuilt(given.limit(0)), "conv", ["part", "place"]).collect() == []
