"""Conversation repair against a search over all audits, with colliding hashes, folded audits and odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from postwatch.llm import registry, repair
from postwatch.llm.queries import QUERIES, damaged

SF = "/root/testdata/sf0.001"
SAID = re.compile(r"[^\x20\x09-\x0D]")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def best(rows):
    """Counts, cost, audit and hash of one conversation, by a uniform-cost search over audits as strings."""
    seen, faults, counts = set(), [], Counter()
    for _, role, text in rows:
        said = SAID.findall(text)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else None if said[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
        counts[fault] += 1
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    heap, found = [(0, "", 0, "", ())], None
    while heap:
        cost, audit, i, initials, out = heapq.heappop(heap)
        if found and cost > found[0]:
            break
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials) and (found is None or (cost, audit) < found[:2]):
            found = cost, audit, out
        if not re.fullmatch("s?(ua)*u?", initials):
            continue
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, initials, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, initials + (role[:1] or "-"), (*out, (role, text))))
                for to in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, initials + to[0], (*out, (to, text))))
        for to in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", i, initials + to[0], (*out, (to, ""))))
    text = "\n".join(f"{r}:{x}" for r, x in found[2])
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, found[0], found[1], sha(text)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


@pytest.mark.parametrize("prime, fold", [(repair.PRIME, repair.FOLD), (3, repair.FOLD), (repair.PRIME, 6), (2, 9)])
def test_cheapest_audit(prime, fold):
    """With a prime of 2 or 3 nearly all hashes collide; with 6 nodes audits are folded after every row or two."""
    rng = random.Random(7)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", " ", ""]
    texts = ["", "Hi.", "Hi.", "ok?", "cut", " \t", "b.", "c!", "cut "]
    for _ in range(300):
        rows = in_order([(rng.choice([None, i, i, i + 3]), rng.choice(roles), rng.choice(texts)) for i in range(rng.randint(0, 6))])
        one, first = repair.Conversation(prime, fold), {}
        for turn, role, text in rows:
            one.add(turn, role, text, first.setdefault((role, text), turn) != turn)
        assert one.result() == best(rows), rows


def test_long_conversation():
    """Audits are as long as their conversation; nodes are not."""
    rng = random.Random(8)
    one = repair.Conversation()
    for i in range(20_000):
        one.add(i, rng.choice(["user", "assistant", "system"]), "" if i > 10_000 else rng.choice(["a.", "b", f"{i}."]), False)
        assert len(one.audits.letter) <= repair.FOLD + 16
    found = one.result()
    assert len(found[6].replace("I", "")) == 20_000 and found[6].endswith("D" * 9_000)


def damage(conv, turn, role, text):
    key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
    code = zlib.crc32(key.encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    if code == 0:
        return []
    text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
    return [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)


def expected(rows):
    by = defaultdict(list)
    for conv, *row in rows:
        by[conv] += damage(conv, *row)
    return {conv: best(in_order(r)) for conv, r in by.items()}


def test_query(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist()]
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op12_repair"](spark, SF).collect()}
    assert got == expected(rows)


def test_odd_rows(spark):
    registry.ship(spark)
    rng = random.Random(9)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, 0, 1, 2]), rng.choice([None, "", "user", "assistant"]), rng.choice([None, "", "x.", "y", "z!"])) for _ in range(12)]
    rows += [(7, i, "user" if i % 2 == 0 else "assistant", f"turn {i}. " + "long " * 20_000 + ".") for i in range(4)] + [(8, 0, "user", "x.")] * 3
    rows += [(c, 1, "user", "x.") for c in range(100, 160)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, conv int")
    marked = damaged(frame)
    out = repair.repair(marked, gone="gone")
    got = out.collect()
    want = expected(rows)
    assert len(got) == len(want) and {r[0]: tuple(r[1:]) for r in got} == want
    none = [r for r in got if r["conv_id"] in want and want[r["conv_id"]][6] == ""]
    assert any(tuple(r[1:]) == (0, 0, 0, 0, 0, 0, "", sha("")) for r in none)
    turns = defaultdict(list)
    for r in repair.repaired_turns(marked, out, gone="gone").collect():
        turns[r["conv_id"]].append((r["place"], r["role"], r["text"]))
    for r in got:
        kept = sorted(turns[r["conv_id"]])
        assert [p for p, _, _ in kept] == list(range(len(kept)))
        assert sha("\n".join(f"{role}:{text}" for _, role, text in kept)) == r["repaired_sha256"]
    assert repair.repair(frame.limit(0)).collect() == []
