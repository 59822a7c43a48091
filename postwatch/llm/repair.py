"""Repair of the structure of conversations, with an audit of the cheapest edits.

A repaired conversation is empty, or an optional system turn and then pairs of a user and an assistant turn, by the
first character of their roles.  Edits are letters: ``K`` keeps a row (0), ``R`` sets its role to ``user`` or
``assistant`` (1), ``D`` deletes it (2; the only choice for blank and for duplicate rows), ``I`` inserts an empty turn (5).  A
truncated row that stays costs 5 more.  Of the cheapest audits the smallest in ASCII order is taken.

The dynamic program goes over the rows of a conversation with four states (nothing yet, system, user, assistant) and
keeps one audit for each.  Audits are persistent: nodes that share their prefixes, each with its binary-lifting
ancestors and a rolling hash.  Equal costs are decided by a search for the longest common prefix of two nodes; that the
prefixes are equal is verified behind the hashes.  Audits of one state and one cost are never prefixes of each other, as
they could differ by insertions alone, so the smaller of them stays the smaller one.  From time to time the nodes are
folded: what the live states have written goes to byte strings, and only their order stays in the tree.  So a
conversation of any length streams through a task; held are a few thousand nodes, and at most four bytes a row of
audits.  A state that another one beats at every possible end is dropped.

- A null role or text is one space; a null turn comes before the others; rows of one turn go by role and text.
- A null conversation id is a conversation of its own.  Rows that repeat are duplicates.
- A conversation of which all rows are ``gone`` gives zeros, an empty audit and the hash of the empty text.
- An empty table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwatch.llm.common import keep, keyed_join

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: State behind a kept row, by state and first character of the role.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: State behind an inserted or renamed turn.
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLE = {USER: b"user", ASSISTANT: b"assistant"}
LEGAL = {"su", "ua", "au"}

BASE, PRIME = 1_000_003, (1 << 61) - 1
#: Nodes at which audits are folded.
FOLD = 4096


class Audits:
    """Audits as nodes of a tree; node 0 is the empty one."""

    def __init__(self, prime: int = PRIME):
        self.prime = prime
        self._clear()

    def _clear(self):
        self.letter, self.depth, self.hash, self.up = [0], [0], [0], [[]]
        self.made: dict[tuple[int, int], int] = {}
        self.written: dict[int, tuple | None] = {0: None}

    def add(self, node: int, letter: int) -> int:
        found = self.made.get((node, letter))
        if found is not None:
            return found
        new = self.made[node, letter] = len(self.letter)
        up, k = [node], 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + letter + 1) % self.prime)
        self.up.append(up)
        return new

    def lift(self, node: int, depth: int) -> int:
        steps = self.depth[node] - depth
        while steps:
            k = steps.bit_length() - 1
            node = self.up[node][k]
            steps -= 1 << k
        return node

    def _split(self, x: int, y: int) -> tuple[int, int]:
        """The uppermost ancestors of two nodes of one depth that differ in their letter; equal nodes where none do."""
        found = (x, x)
        while x != y:
            if self.letter[x] != self.letter[y]:
                found = x, y
            x, y = self.up[x][0], self.up[y][0]
        return found

    def less(self, a: int, b: int) -> bool:
        """Whether the audit of ``a`` comes before that of ``b`` in ASCII order."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.lift(a, depth), self.lift(b, depth)
        if self.hash[x] != self.hash[y]:
            for k in reversed(range(len(self.up[x]))):
                if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
            above = self.up[x][0], self.up[y][0]
        else:
            above = x, y
        # Equal hashes do not prove equal prefixes.  Nodes are shared, so this is mostly one comparison.
        p, q = self._split(*above)
        if p != q:
            return self.letter[p] < self.letter[q]
        if above != (x, y):
            return self.letter[x] < self.letter[y]
        return self.depth[a] < self.depth[b]

    def letters(self, node: int, top: int = 0) -> bytes:
        """What is between an ancestor and a node."""
        out = bytearray()
        while node != top and node not in self.written:
            out.append(self.letter[node])
            node = self.up[node][0]
        return bytes(reversed(out))

    def rope(self, node: int):
        """Everything up to a node, as a chain of byte strings."""
        tail = self.letters(node)
        at = self.lift(node, self.depth[node] - len(tail))
        return (self.written[at], tail) if tail else self.written[at]

    def text(self, node: int) -> str:
        parts, rope = [], self.rope(node)
        while rope is not None:
            rope, tail = rope
            parts.append(tail)
        return b"".join(reversed(parts)).decode("ascii")

    def fold(self, nodes: list[int]) -> list[int]:
        """Forget all but the given nodes; gives their new numbers."""
        from functools import cmp_to_key

        order = sorted(set(nodes), key=cmp_to_key(lambda a, b: -1 if self.less(a, b) else 1))
        # An audit that goes on from another one comes behind it, and keeps the letters between.
        kept: list[tuple[int, int | None, bytes, tuple | None]] = []
        for node in order:
            inside = [m for m in order if m != node and self.depth[m] < self.depth[node] and self.lift(node, self.depth[m]) == m]
            top = max(inside, key=self.depth.__getitem__, default=None)
            kept.append((node, top, b"" if top is None else self.letters(node, top), self.rope(node)))
        self._clear()
        now: dict[int, int] = {}
        for rank, (node, top, between, rope) in enumerate(kept):
            if top is None:
                now[node] = self.add(0, rank)
                self.written[now[node]] = rope
            else:
                new = now[top]
                for letter in between:
                    new = self.add(new, letter)
                now[node] = new
        return [now[n] for n in nodes]


class Conversation:
    """The state of one conversation while its rows pass."""

    def __init__(self, prime: int = PRIME, fold: int = FOLD):
        self.audits, self.fold = Audits(prime), fold
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = self.initial = self.row = None
        self.turns = 0
        # State: cost, audit, running hash of the repaired rows.
        self.cells = {START: (0, 0, hashlib.sha256())}
        self._insert()

    def add(self, turn, role: str, text: str, later: bool) -> None:
        again = later or self.row == (turn, role, text)
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        initial = role[:1]
        if self.row is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.row, self.initial = (turn, role, text), initial
        said = text.rstrip(BLANKS)
        blank, duplicate = not said, bool(said) and again
        truncated = not blank and not duplicate and said[-1] not in ".!?"
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self._step(initial, role, text, blank or duplicate, TRUNCATED if truncated else 0)

    def _offer(self, new: dict, state: int, cost: int, node: int, letter: str, sha, said) -> None:
        best = new.get(state)
        if best is not None and best[0] < cost:
            return
        node = self.audits.add(node, ord(letter))
        if best is None or cost < best[0] or self.audits.less(node, best[1]):
            new[state] = cost, node, sha, said

    def _step(self, initial, role, text, must_go, extra) -> None:
        new: dict[int, tuple] = {}
        body = None
        for state, (cost, node, sha) in self.cells.items():
            self._offer(new, state, cost + DELETE, node, "D", sha, None)
            if must_go:
                continue
            if body is None:
                body = b":" + text.encode()
            join = b"" if state == START else b"\n"
            kept = AFTER.get((state, initial))
            if kept is not None:
                self._offer(new, kept, cost + KEEP + extra, node, "K", sha, (join, role.encode(), body))
            to = NEXT[state]
            self._offer(new, to, cost + REROLE + extra, node, "R", sha, (join, ROLE[to], body))
        self.cells = {state: (cost, node, self._said(sha, said)) for state, (cost, node, sha, said) in new.items()}
        self._insert()
        if len(self.audits.letter) > self.fold:
            nodes = self.audits.fold([c[1] for c in self.cells.values()])
            self.cells = {s: (c[0], n, c[2]) for (s, c), n in zip(self.cells.items(), nodes)}

    @staticmethod
    def _said(sha, said):
        if said is None:
            return sha
        sha = sha.copy()
        for part in said:
            sha.update(part)
        return sha

    def _insert(self) -> None:
        """Insertions from the cheapest state on, then states that cannot win any more are dropped."""
        cells, done = self.cells, set()
        while len(done) < len(cells):
            state = min((s for s in cells if s not in done), key=lambda s: cells[s][0])
            done.add(state)
            to, (cost, node, sha) = NEXT[state], cells[state]
            there = cells.get(to)
            if there is not None and there[0] < cost + INSERT:
                continue
            new = self.audits.add(node, ord("I"))
            if there is None or cost + INSERT < there[0] or self.audits.less(new, there[1]):
                cells[to] = cost + INSERT, new, self._said(sha, (b"" if state == START else b"\n", ROLE[to], b":"))
        # Whatever goes on from nothing or from a system turn goes on from an assistant turn as well, but for a kept
        # system turn, which is deleted there.
        paired = cells[ASSISTANT][0]
        if START in cells and cells[START][0] > paired + DELETE:
            del cells[START]
        if SYSTEM in cells and cells[SYSTEM][0] > paired:
            del cells[SYSTEM]

    def result(self) -> tuple:
        """Gaps, blank, duplicate, truncated and illegal counts, cost, audit and hash."""
        ends = [self.cells[s] for s in (START, ASSISTANT) if s in self.cells]
        best = ends[0]
        for end in ends[1:]:
            if end[0] < best[0] or end[0] == best[0] and self.audits.less(end[1], best[1]):
                best = end
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, best[0],
                self.audits.text(best[1]), best[2].hexdigest())


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows of a conversation together, in order, each with ``later``: whether its role and text have an earlier turn."""
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.withColumn("digest", F.when(~F.col("gone"), digest))
    # Counts are made before the shuffle; only what occurs again is looked up.
    again = (
        rows.filter(~F.col("gone"))
        .groupBy(F.col("conv").alias("a_conv"), F.col("digest").alias("a_digest"))
        .agg(F.count("*").alias("n"), F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("open"))
        .filter("n > 1")
        .drop("n")
    )
    found = keyed_join(rows, keep(again, "again"), [("conv", "a_conv"), ("digest", "a_digest")], ["turn"])
    later = F.when(F.col("open"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first"))
    return (
        found.select("conv", "turn", "role", "text", "gone", F.coalesce(later, F.lit(False)).alias("later"))
        .repartition("conv")
        .sortWithinPartitions("conv", "gone", F.col("turn").asc_nulls_first(), "role", "text")
    )


def _rows(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, gone) -> DataFrame:
    absent = F.lit(False) if gone is None else F.coalesce(F.col(gone) if isinstance(gone, str) else gone, F.lit(False))
    return df.select(
        F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"),
        F.coalesce(text_col, F.lit(" ")).alias("text"), absent.alias("gone"),
    )


def repair(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", gone=None,
) -> DataFrame:
    """A row per conversation: its id, counts of its faults, ``cost``, ``audit`` and the hash of the repaired rows.

    Rows for which ``gone`` is true only name their conversation.
    """
    rows = _rows(conversations, id_col, turn_col, role_col, text_col, gone)
    kinds = [T.StructField(c, T.StringType() if c in COLUMNS[-2:] else T.LongType()) for c in COLUMNS]
    schema = T.StructType([T.StructField(id_col, rows.schema["conv"].dataType), *kinds])

    def run(batches):
        name, now = None, None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "gone", "later")]
            for conv, turn, role, text, absent, later in zip(*columns):
                if now is None or conv != name:
                    if now is not None:
                        out.append((name, *now.result()))
                    name, now = conv, Conversation()
                if not absent:
                    now.add(turn, role, text, later)
            if out:
                yield _batch(out, schema)
        if now is not None:
            yield _batch([(name, *now.result())], schema)

    return _ordered(rows).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def repaired_turns(
    conversations: DataFrame, audits: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text", gone=None,
) -> DataFrame:
    """The repaired rows ``(id, place, role, text, edit)``: the audits of ``repair`` applied to the rows they are of."""
    rows = _rows(conversations, id_col, turn_col, role_col, text_col, gone).filter(~F.col("gone"))
    kind = rows.schema["conv"].dataType
    schema = T.StructType(
        [T.StructField(id_col, kind), T.StructField("place", T.LongType()), T.StructField("role", T.StringType()),
         T.StructField("text", T.StringType()), T.StructField("edit", T.StringType())]
    )
    both = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", "text").unionAll(
        audits.select(F.col(id_col).alias("conv"), F.lit(0), F.lit(None).cast("long"), F.lit(""), "audit")
    )

    def run(batches):
        name, edits, at, state, place = None, "", 0, START, 0

        def inserted(out):
            nonlocal at, state, place
            while at < len(edits) and edits[at] == "I":
                state = NEXT[state]
                out.append((name, place, ROLE[state].decode(), "", "I"))
                at, place = at + 1, place + 1

        for batch in batches:
            out = []
            for conv, what, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text"))):
                if what == 0:
                    inserted(out)
                    name, edits, at, state, place = conv, text, 0, START, 0
                    continue
                inserted(out)
                edit = edits[at]
                at += 1
                if edit == "D":
                    continue
                state = NEXT[state] if edit == "R" else AFTER[state, role[:1]]
                out.append((name, place, ROLE[state].decode() if edit == "R" else role, text, edit))
                place += 1
            if out:
                yield _batch(out, schema)
        out = []
        inserted(out)
        if out:
            yield _batch(out, schema)

    return (
        both.repartition("conv")
        .sortWithinPartitions("conv", "kind", F.col("turn").asc_nulls_first(), "role", "text")
        .mapInArrow(run, schema)
    )
