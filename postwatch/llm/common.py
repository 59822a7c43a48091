"""Helpers that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.operators.lookup import BROADCAST_BYTES, SALTS, measured_bytes
from postwatch.session import keep

__all__ = ["components", "fresh", "keep", "keyed_join", "match", "text_hash", "words_split"]

#: Words are separated by ASCII white space alone.
SPACE = r"[\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that ``df`` does not have yet: each given name, with underscores where it is taken."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_hash(text: Column | str) -> Column:
    """Tells rows of one ``doc_id`` apart; a null text counts as the empty one."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def words_split(text: Column) -> Column:
    """The words of a text, without the empty ones that a split leaves at the ends."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def match(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> Column:
    """Equality of key columns in which null equals null."""
    return reduce(lambda a, b: a & b, (left[a].eqNullSafe(right[b]) for a, b in keys))


def keyed_join(
    rows: DataFrame,
    dictionary: DataFrame,
    keys: list[tuple[str, str]],
    spread: list[str],
    how: str = "left",
    limit: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``rows`` with a stored ``dictionary`` that has at most one row per key; null equals null.

    ``keys`` are pairs (column of rows, column of dictionary), whose names must differ; the
    dictionary's columns stay in the result.  Up to ``limit`` measured bytes the dictionary is
    broadcast.  Beyond, both sides are shuffled by key and salt, so that the rows of a hot key
    spread over ``salts`` tasks, and every dictionary row is there once per salt.  One salt is for keys
    that cannot be hot, such as hashes of a row's own place; no limit is for dictionaries that grow with
    the rows, which are then shuffled at every size.  The hint keeps Spark from broadcasting what is to be shuffled: it
    goes by the size of the files, which are compressed, and the copies count for nothing in it.
    """
    if limit and measured_bytes(dictionary) <= limit:
        return rows.join(F.broadcast(dictionary), match(rows, dictionary, keys), how)
    if salts == 1:
        return rows.join(dictionary.hint("merge"), match(rows, dictionary, keys), how)
    salt, other = fresh(rows, "_salt", "_salt_of")
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = dictionary.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(copies.hint("merge"), match(rows, copies, [*keys, (salt, other)]), how).drop(salt, other)


def _changes(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``links (a, b)`` as ``(node, component)``.

    Nodes are longs, and a component is named by its smallest node.  Alternating large-star and
    small-star rounds: every round writes its edges to the shared folder, so the lineage stays
    short, and a node's neighbours only ever meet in a minimum.  Links of a node with itself and
    repeated links count for nothing; no links give no rows.
    """
    ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = keep(ends.filter("u <> v").distinct(), "edges")
    before = _changes(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (
            both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        large = keep(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        edges = keep(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _changes(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components have not settled")
    tops = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        tops.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
