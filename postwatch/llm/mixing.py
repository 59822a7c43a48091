"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source's documents are dealt by hash into blocks, in a fixed permuted order.  A source's target gives
whole passes over its blocks and a last pass that ends inside one block, so its exact quota of block draws is
known.  The quotas of all sources are split among the output shards by a binary tree: each node draws
the left half's share of every source from the multivariate hypergeometric distribution.  A shard then takes
its own run of each source's permuted draws, so shards are disjoint, and shuffles them locally.

Draws depend on the seed, ids and texts alone, so reruns agree.  What comes to the driver is one row per
source, the recipe's own size; a source has at most ``MAX_BLOCKS`` blocks.

Defined results: a null or empty text has size 0 and is taken with its block at no words; a null source is a
source of its own, last in the order; a source without words has target 0; repeated rows are rows of their
own that are taken alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwatch.llm.common import fresh, keep, keyed_join, text_hash

WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix, as a share of all words, and passes over a source at most.
SHARE = 1.5
CAP = 2.0
SHARDS = 64
#: Words of a block, about, and blocks of a source at most.
BLOCK_WORDS = 100_000
MAX_BLOCKS = 1 << 16
SEED = 20240607
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict:
    """Words to take from each source: by weight, at most ``cap`` times its size, the excess reshared.

    Sources are in the order of code points, null last, and the weights repeat along them.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict = {}
    left, open_ = share * sum(sizes.values()), list(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > cap * sizes[s]]
        if not full:
            out |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def split_tree(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Quotas of each shard (shards x sources), whose sums are the given quotas."""
    out = np.zeros((shards, len(quotas)), np.int64)
    work = [(0, shards, np.array(quotas, np.int64))]
    while work:
        first, last, q = work.pop()
        if last - first == 1:
            out[first] = q
            continue
        mid = (first + last) // 2
        n = int(q.sum()) * (mid - first) // (last - first)
        rng = np.random.default_rng([seed, first, last])
        left = rng.multivariate_hypergeometric(q, n, method="marginals") if len(q) else q
        work += [(first, mid, left), (mid, last, q - left)]
    return out


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, more: Sequence[Column] = ()) -> DataFrame:
    """``(doc_id, th, source, size, u)`` and ``more``; ``u`` is the row's place in the permuted order."""
    th = text_hash(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), th.alias("th"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), th).alias("u"), *more,
    )


def blocked(rows: DataFrame, recipe: DataFrame) -> DataFrame:
    """``rows`` with their source's recipe and their ``block``."""
    return keyed_join(rows, recipe, [("source", "of")], ["doc_id", "th"]).withColumn(
        "block", F.pmod("u", F.col("blocks").cast("long")).cast("int")
    )


def schedule(
    rows: DataFrame,
    weights=WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    shards: int = SHARDS,
    seed: int = SEED,
    block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The recipe, each block's draws and the cuts, of the rows that ``sized`` gives.

    What the mix takes of a row follows from these, its source and its ``u``: tables of sources and blocks, not of rows.
    """
    spark = rows.sparkSession
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = targets(sizes, weights, share, cap)
    blocks = {
        s: min(MAX_BLOCKS, 1 << max(0, math.ceil(math.log2(max(1, sizes[s] / block_words))))) for s in names
    }
    passes = {s: int(goal[s] // sizes[s]) if sizes[s] else 0 for s in names}
    recipe = keep(
        spark.createDataFrame(
            [(s, sizes[s], float(goal[s]), blocks[s], passes[s], float(goal[s] - passes[s] * sizes[s])) for s in names],
            "of string, source_size long, target double, blocks int, passes int, rest double",
        ),
        "recipe",
    )
    placed = blocked(rows, recipe)
    # One row per block; the last pass ends in the first block that reaches over the rest.
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    table = keep(
        placed.groupBy("source", "block", "passes", "rest")
        .agg(F.sum("size").alias("words"))
        .withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .withColumn("whole", F.col("before") + F.col("words") <= F.col("rest"))
        .withColumn("partly", ~F.col("whole") & (F.col("before") < F.col("rest"))),
        "blocks",
    )
    edge = table.filter("partly").select(
        F.col("source").alias("es"), F.col("block").alias("eb"), F.col("before").alias("eo"), F.col("rest").alias("er")
    )
    inside = keyed_join(placed, keep(edge, "edges"), [("source", "es"), ("block", "eb")], ["doc_id", "th"], "inner")
    run = Window.partitionBy("source").orderBy("u").rangeBetween(Window.unboundedPreceding, -1)
    cut = keep(
        inside.withColumn("done", F.col("eo") + F.coalesce(F.sum("size").over(run), F.lit(0)))
        .filter(F.col("done") + F.col("size") / 2 <= F.col("er"))
        .groupBy(F.col("source").alias("cs"), F.col("block").alias("cb"))
        .agg(F.max("u").alias("cut")),
        "cuts",
    )
    # Block draws of a source in a permuted order, and each shard's run of them.
    each = F.explode(
        F.filter(
            F.sequence(F.lit(0), F.col("passes")),
            lambda p: (p < F.col("passes")) | F.col("whole") | F.col("partly"),
        )
    )
    drawn = table.select("source", "block", "partly", "passes", each.alias("pass"))
    by_hash = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "block", "pass"), "block", "pass")
    ranked = keep(drawn.withColumn("rank", F.row_number().over(by_hash) - 1), "draws")
    quota = {r["source"]: r["n"] for r in ranked.groupBy("source").agg(F.count("*").alias("n")).collect()}
    tree = np.cumsum(split_tree([quota.get(s, 0) for s in names], shards, seed), axis=0)
    ends = spark.createDataFrame(
        [(s, [int(x) for x in tree[:, i]]) for i, s in enumerate(names)], "qs string, ends array<long>"
    )
    dealt = keep(
        keyed_join(ranked, keep(ends, "ends"), [("source", "qs")], ["block", "pass"])
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))))
        .groupBy(F.col("source").alias("ds"), F.col("block").alias("db"))
        .agg(F.array_sort(F.collect_list(F.struct(
            "pass", "shard", (F.col("partly") & (F.col("pass") == F.col("passes"))).alias("part")
        ))).alias("of_block")),
        "dealt",
    )
    return recipe, dealt, cut


def drawn(rows: DataFrame, scheduled: tuple[DataFrame, DataFrame, DataFrame], seed: int = SEED) -> DataFrame:
    """``rows (doc_id, th, source, u, ...)`` with ``source_size``, ``target`` and ``draws``."""
    recipe, dealt, cut = scheduled
    joined = keyed_join(blocked(rows, recipe), dealt, [("source", "ds"), ("block", "db")], ["doc_id", "th"])
    joined = keyed_join(joined, cut, [("source", "cs"), ("block", "cb")], ["doc_id", "th"])
    kept = F.filter("of_block", lambda d: ~d["part"] | F.coalesce(F.col("u") <= F.col("cut"), F.lit(False)))
    draws = F.transform(kept, lambda d: F.struct(
        d["pass"].alias("pass"), d["shard"].alias("shard"),
        F.xxhash64(F.lit(seed), d["shard"], d["pass"], F.col("u")).alias("place"),
    ))
    none = F.array().cast("array<struct<pass:int,shard:int,place:bigint>>")
    return joined.select(*rows.columns, "source_size", "target", F.coalesce(draws, none).alias("draws"))


def plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options
) -> DataFrame:
    """``(doc_id, th, source, size, source_size, target, draws)`` of every row.

    ``draws`` has a struct ``(pass, shard, place)`` for each time that the mix takes the document;
    ``place`` orders a shard.  ``options`` are those of ``schedule``.
    """
    rows = keep(sized(docs, id_col, text_col, source_col, seed), "sized")
    return drawn(rows, schedule(rows, seed=seed, **options), seed).drop("u")


def taken() -> Column:
    """Words that the mix takes of a row of ``plan``, repeats counted."""
    return (F.col("size") * F.size("draws")).cast("long")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options
) -> DataFrame:
    """The mixed rows: the columns of ``docs``, ``pass``, ``shard`` and ``place``, a row per draw.

    The rows of a shard lie together, shuffled: in the order of their places, which are hashes of the seed, the draw and the row.
    A row finds its draws by its source and block, so that nothing is joined by id.
    """
    pass_, shard, place = fresh(docs, "pass", "shard", "place")
    scheduled = schedule(keep(sized(docs, id_col, text_col, source_col, seed), "sized"), seed=seed, **options)
    # Columns of docs by their places, as their names can be those of the plan.
    own = [f"column_{i}" for i in range(len(docs.columns))]
    keys = sized(docs, id_col, text_col, source_col, seed, [F.col(c).alias(o) for c, o in zip(docs.columns, own)]).drop("size")
    draws = drawn(keys, scheduled, seed).select(*own, F.explode("draws").alias("draw"))
    mixed = draws.select(
        *[F.col(o).alias(c) for c, o in zip(docs.columns, own)],
        F.col("draw.pass").alias(pass_), F.col("draw.shard").alias(shard), F.col("draw.place").alias(place),
    )
    return mixed.repartition(shard).sortWithinPartitions(shard, place)
