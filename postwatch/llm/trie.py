"""A trie of what conversations share from their start on, built as burst tries.

A turn is known by a digest of 16 bytes, a sequence by the digests of its turns.  Sequences that are equal are held
once, with their number.  A container holds the suffixes of all sequences below one trie head, that is, one first
stretch of turns.  First there is a container per first turn.  Containers of more than ``limit`` suffixes are burst:
their head becomes a node, and their suffixes go to containers by their next turn, round after round.  The
other containers are dealt over the shards, sorted, and swept into nodes: a suffix shares with the one before
it the nodes of their longest common prefix.  Heads sum up what hangs on them, from the deepest up.

A sequence is held up to its first ``HELD`` turns, and beyond only as far as another sequence shares them.  What
follows is a tail: a chain of nodes without branches, whose sums follow from running sums.  So a container is bounded
however long a conversation is; a conversation itself only streams through a task, as rows of 50 bytes.

- Rows without an id belong to no conversation and are left out.  A null key names a conversation without adding a turn.
- Rows of a conversation that tie in the order and differ in their key go by key; rows that repeat are turns of their own.
- An empty table gives an empty result, without a root.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.llm.common import keep, keyed_join

#: Suffixes of a container.
LIMIT = 250
#: Turns up to which a sequence is held, shared or not.
HELD = 64
NO_ENDS = hashlib.sha256(b"").hexdigest()

CHAIN = pa.schema(
    [("conv", pa.int64()), ("place", pa.int64()), ("turns", pa.int64()), ("chars", pa.int64()), ("before", pa.int64()),
     ("key", pa.binary()), ("ids", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64()))]
)
CHAIN_DDL = (
    "conv long, place long, turns long, chars long, before long, key binary, ids array<binary>, sizes array<long>"
)
GROUP = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("conv", pa.int64()), ("ends", pa.string())])
NODE = pa.schema(
    [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
     ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
     ("head", pa.binary())]
)
NODE_DDL = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, head binary"
)
#: Key of the root.
ROOT = b""


def turn_key(role: Column, text: Column) -> Column:
    """16 bytes that tell turns apart; the length keeps role and text apart."""
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(said, 256)), 1, 16)


def _below(key: Column, turn: Column) -> Column:
    """Key of the stretch that goes on with ``turn``."""
    return F.substring(F.unhex(F.sha2(F.concat(key, turn), 256)), 1, 16)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _chains(held: int):
    """A row at place 0 per conversation, which has its whole digest and its first turns, and one per later turn."""

    def run(batches):
        now = None
        for batch in batches:
            out = []
            for conv, turn, size in zip(*(batch.column(n).to_pylist() for n in ("conv", "key", "size"))):
                if conv != now:
                    if now is not None:
                        out.append((now, 0, place, chars, 0, key, ids, sizes))
                    now, place, chars, key, ids, sizes = conv, 0, 0, b"", [], []
                if turn is None:
                    continue
                place += 1
                key = hashlib.sha256(key + turn).digest()[:16]
                if place <= held:
                    ids.append(turn)
                    sizes.append(size)
                else:
                    out.append((conv, place, place, size, chars, key, [turn], [size]))
                chars += size
            if out:
                yield _batch(out, CHAIN)
        if now is not None:
            yield _batch([(now, 0, place, chars, 0, key, ids, sizes)], CHAIN)

    return run


def _copies(batches):
    """Number, smallest conversation and digest of all conversations of each sequence; they come in ascending order."""
    now = None
    for batch in batches:
        out = []
        for key, conv in zip(*(batch.column(n).to_pylist() for n in ("key", "conv"))):
            if key != now:
                if now is not None:
                    out.append((now, n, first, ends.hexdigest()))
                now, n, first, ends = key, 0, conv, hashlib.sha256()
            ends.update(b",%d" % conv if n else b"%d" % conv)
            n += 1
        if out:
            yield _batch(out, GROUP)
    if now is not None:
        yield _batch([(now, n, first, ends.hexdigest())], GROUP)


class Container:
    """The suffixes below one head, in order, swept into nodes."""

    def __init__(self, depth: int, head: bytes):
        #: Per node: depth, characters, smallest member, members, children, leaves, saved, ends, parent.
        self.nodes: list[list] = []
        self.depth, self.head = depth, head
        self.path: list[int] = []
        self.last: list[bytes] = []
        self.tails: list[tuple] = []

    def add(self, conv, n, ids, sizes, turns, chars, ends) -> None:
        own = ids[self.depth - 1 :]
        same = 0
        while same < min(len(own), len(self.last)) and own[same] == self.last[same]:
            same += 1
        del self.path[same:]
        for depth in range(same, len(own)):
            parent = self.path[-1] if self.path else None
            if parent is not None:
                self.nodes[parent][4] += 1
            self.path.append(len(self.nodes))
            self.nodes.append([self.depth + depth, sizes[self.depth - 1 + depth], conv, 0, 0, 0, 0, None, parent])
        for at in self.path:
            node = self.nodes[at]
            node[2] = min(node[2], conv)
            node[3] += n
        end = self.nodes[self.path[-1]]
        if turns == len(ids):
            end[7] = ends
        else:
            saved = (n - 1) * (chars - sum(sizes))
            end[4] += 1
            end[5] += 1
            end[6] += saved
            more = turns - len(ids) - 1
            self.tails.append((conv, len(ids) + 1, self.path[-1], n, int(more > 0), 1, saved, NO_ENDS if more else ends))
        self.last = own

    def rows(self):
        for node in reversed(self.nodes):
            depth, chars, _, n, children, leaves, saved, _, parent = node
            node[5] = leaves or 1
            node[6] = saved + (n - 1) * chars
            if parent is not None:
                self.nodes[parent][5] += node[5]
                self.nodes[parent][6] += node[6]
        for depth, _, conv, n, children, leaves, saved, ends, parent in self.nodes:
            above = None if parent is None else self.nodes[parent][2]
            yield conv, depth, above, n, children, leaves, saved, ends or NO_ENDS, self.head if parent is None else None
        for conv, depth, parent, *rest in self.tails:
            yield conv, depth, self.nodes[parent][2], *rest, None


def _sweep(batches):
    names = ("key", "head", "depth", "conv", "n", "ids", "sizes", "turns", "chars", "ends")
    now, container = None, None
    for batch in batches:
        out = []
        for key, head, depth, *suffix in zip(*(batch.column(n).to_pylist() for n in names)):
            if key != now:
                if container is not None:
                    out.extend(container.rows())
                now, container = key, Container(depth, head)
            container.add(*suffix)
        if out:
            yield _batch(out, NODE)
    if container is not None:
        yield _batch(list(container.rows()), NODE)


def _sequences(turns: DataFrame, order: list, held: int) -> tuple[DataFrame, DataFrame]:
    """The distinct sequences, as far as they are held, and the rows of their tails."""
    chains = keep(
        turns.repartition("conv").sortWithinPartitions("conv", *order, F.col("key").asc_nulls_first())
        .select("conv", "key", "size").mapInArrow(_chains(held), CHAIN_DDL),
        "chains",
    )
    whole, deep = chains.filter("place = 0"), chains.filter("place > 0")
    groups = (
        whole.select("key", "conv").repartition("key").sortWithinPartitions("key", "conv")
        .mapInArrow(_copies, "key binary, n long, conv long, ends string").drop("key")
    )
    ours = keep(whole.drop("key", "place", "before").join(groups, "conv"), "sequences")
    # Later turns of the sequences: those with a first stretch that another sequence has as well are held too.
    long = ours.filter(F.col("turns") > held).select(F.col("conv").alias("l_conv"), "n", "turns", F.col("chars").alias("total"), "ends")
    later = keyed_join(deep.drop("turns"), keep(long, "long"), [("conv", "l_conv")], ["place"], "inner").drop("l_conv")
    later = keep(later, "later")
    shared = later.groupBy(F.col("key").alias("s_key")).agg(F.count("*").alias("times")).filter("times > 1")
    later = keyed_join(later, keep(shared, "shared"), [("key", "s_key")], ["conv"])
    more = later.filter("times is not null").groupBy(F.col("conv").alias("m_conv")).agg(
        F.array_sort(F.collect_list(F.struct("place", F.col("ids")[0].alias("id"), F.col("chars").alias("size")))).alias("m")
    )
    found = keyed_join(ours, keep(more, "more"), [("conv", "m_conv")], ["conv"], salts=1)
    found = found.withColumn("ids", F.when(F.col("m").isNull(), F.col("ids")).otherwise(F.concat("ids", "m.id")))
    found = found.withColumn("sizes", F.when(F.col("m").isNull(), F.col("sizes")).otherwise(F.concat("sizes", "m.size")))
    return found.drop("m", "m_conv"), later.filter("times is null")


def _tails(rows: DataFrame) -> DataFrame:
    """Nodes of the tails; the first node of each comes from the container that it hangs on."""
    saved = (F.col("n") - 1) * (F.col("total") - F.col("before"))
    last = F.col("place") == F.col("turns")
    nodes = rows.select(
        F.col("conv").alias("conv_id"), F.col("place").alias("depth"), F.col("conv").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        saved.alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(NO_ENDS).alias("ends_sha256"),
        F.lit(None).cast("binary").alias("head"), (F.col("place") - 1).alias("above"),
    )
    # Places of one conversation's tail are gapless, so the first node is the one without a row above it.
    first = rows.groupBy("conv").agg(F.min("place").alias("first")).select(F.col("conv").alias("f_conv"), "first")
    joined = keyed_join(nodes, keep(first, "first"), [("conv_id", "f_conv")], ["depth"], "inner")
    return joined.filter("depth > first").select(*NODE.names)


def prefix_trie(
    turns: DataFrame, id_col: str, order: list, key_col: str = "key", size_col: str = "size", limit: int = LIMIT, held: int = HELD
) -> DataFrame:
    """A row per distinct first stretch of ``depth`` turns of the conversations.

    ``turns`` has a row per turn: the conversation, columns of the order, the turn's key and its size.  A node has
    its smallest member, its parent's, the numbers of members, children and leaves below it, the size saved below it
    if each stretch were kept once, and the digest of the members that end in it.
    """
    rows = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), *(F.expr(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)),
        F.col(key_col).alias("key"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"),
    )
    items, tails = _sequences(rows, [F.col(f"o{i}").asc_nulls_first() for i in range(len(order))], held)
    active = keep(items.withColumn("head", F.lit(ROOT)).withColumn("key", F.lit(ROOT)).withColumn("depth", F.lit(0).cast("long")), "suffixes")
    heads, ended, closed, depth = [], [], [], 0
    while True:
        # The root, then few: each of them has more than ``limit`` suffixes.
        big = keep(
            active.groupBy("key")
            .agg(F.count("*").alias("c"), F.min("head").alias("up"),
                 F.max(F.element_at("sizes", depth) if depth else F.lit(0)).cast("long").alias("size"))
            .filter(F.col("c") > (limit if depth else 0))
            .select(F.col("key").alias("b_key"), "up", "size"),
            "heads",
        )
        found = keyed_join(active, big.select("b_key"), [("key", "b_key")], ["conv"])
        burst = found.filter("b_key is not null").drop("b_key")
        heads.append(big)
        closed.append(found.filter("b_key is null").drop("b_key"))
        ended.append(burst.filter(F.size("ids") == depth))
        depth += 1
        active = keep(
            burst.filter(F.size("ids") >= depth)
            .withColumn("head", F.col("key"))
            .withColumn("key", _below(F.col("head"), F.element_at("ids", depth)))
            .withColumn("depth", F.lit(depth).cast("long")),
            "suffixes",
        )
        if active.isEmpty():
            break
    suffixes = reduce(DataFrame.unionAll, closed)
    nodes = keep(
        suffixes.repartition("key").sortWithinPartitions("key", "ids", "conv")
        .select("key", "head", "depth", "conv", "n", "ids", "sizes", "turns", "chars", "ends")
        .mapInArrow(_sweep, NODE_DDL),
        "nodes",
    )
    hung = reduce(DataFrame.unionAll, [_hung(e) for e in ended])
    heads = _sum_heads(heads, nodes.unionAll(hung), reduce(DataFrame.unionAll, ended))
    parent = heads.select(F.col("key").alias("p_key"), F.col("conv_id").alias("p_conv"))
    known = nodes.unionAll(hung).unionAll(_tails(tails)).unionAll(heads.select(*NODE.names))
    found = keyed_join(known, parent, [("head", "p_key")], ["conv_id", "depth"])
    return found.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "p_conv")).select(*NODE.names[:-1])


def _hung(ended: DataFrame) -> DataFrame:
    """First nodes of the tails that hang on a head."""
    held = F.aggregate("sizes", F.lit(0).cast("long"), lambda total, x: total + x)
    more = F.col("turns") > F.size("ids") + 1
    return ended.filter(F.col("turns") > F.size("ids")).select(
        F.col("conv").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), more.cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n") - 1) * (F.col("chars") - held)).alias("saved_tokens"),
        F.when(more, NO_ENDS).otherwise(F.col("ends")).alias("ends_sha256"), F.col("key").alias("head"),
    )


def _sum_heads(heads: list[DataFrame], below: DataFrame, ended: DataFrame) -> DataFrame:
    """Nodes of the heads, from the deepest up, with their ``key``: sums of what hangs on them and of what ends at them."""
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    hangs = below.filter("head is not null").select(
        F.col("head").alias("at"), "conv_id", "n_convs", F.lit(1).cast("long").alias("child"), "n_leaves", "saved_tokens", none.alias("ends")
    )
    ends = ended.filter(F.col("turns") == F.size("ids")).select("key", "conv", "n", zero, zero, zero, "ends")
    parts, out = keep(hangs.unionAll(ends), "parts"), []
    for depth in reversed(range(len(heads))):
        summed = parts.groupBy("at").agg(
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("child").alias("n_children"),
            F.greatest(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.sum("saved_tokens").alias("s"), F.max("ends").alias("ends"),
        )
        level = keep(
            summed.join(heads[depth], F.col("at") == F.col("b_key")).select(
                "conv_id", F.lit(depth).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
                "n_children", "n_leaves", (F.col("s") + (F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"),
                F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
                F.col("up").alias("head"), F.col("at").alias("key"),
            ),
            "head_nodes",
        )
        out.append(level)
        parts = parts.unionAll(level.select("head", "conv_id", "n_convs", F.lit(1).cast("long"), "n_leaves", "saved_tokens", none))
    found = reduce(DataFrame.unionAll, out)
    return found.withColumn("head", F.when(F.col("depth") > 0, F.col("head")))
