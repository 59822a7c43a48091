"""Benchmark decontamination with a positional inverted index, in DataFrame functions alone.

The index holds a posting (term, document, position) for each document word that a benchmark item uses.  Of
each window of item words the rarest terms are looked up; their positions, less the offsets in the item,
must meet in one place, the diagonal, and what meets is compared word by word with the document.  So
frequent words are hardly ever looked up, and a match is exact.

Items and terms come from the benchmark alone.  Tables made of them are joined by ``keyed_join``, which
broadcasts a table of measured size and shuffles, salted, beyond that.

Defined results: a null or empty text has no words and is never hit; an item of fewer words than a window
is one window; repeated items count once; rows that repeat id and text get the same result; items that
share an id are one item; a null item id is written as the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.llm.common import fresh, keep, keyed_join, text_hash

WINDOW = 10
#: Terms of a window whose posting lists are intersected.
RAREST = 3
#: Words that the rarest terms of a near match may be displaced by.
SLOP = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; other letters keep their case."""
    whole = F.coalesce(text, F.lit(""))
    ascii_only = F.length(whole) == F.octet_length(whole)
    low = F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))
    return F.array_remove(F.split(low, BETWEEN), "")


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(ik, item, w)``: a key of id and text, the id as text, the words; items without words are left out."""
    return (
        items.select(
            F.xxhash64(F.col(id_col), F.col(text_col)).alias("ik"),
            F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
            words(F.col(text_col)).alias("w"),
        )
        .filter(F.size("w") > 0)
        .dropDuplicates(["ik"])
    )


def postings(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: ``(term, doc_id, th, pos)`` of the words that items use; ``term`` is a hash.

    Equal hashes of different terms give candidates that the comparison of words takes out again.
    """
    used = keep(items.select(F.explode("w").alias("used")).distinct(), "terms")
    placed = docs.select(
        F.col(id_col).alias("doc_id"), text_hash(text_col).alias("th"),
        F.posexplode(words(F.col(text_col))).alias("pos", "word"),
    )
    found = keyed_join(placed, used, [("word", "used")], ["doc_id", "pos"], "left_semi")
    return found.select(F.hash("word").alias("term"), "doc_id", "th", "pos")


def anchors(items: DataFrame, index: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """``(ik, sets)``: for each window that can occur, the item positions of its rarest terms."""
    frequency = keep(index.groupBy(F.col("term").alias("counted")).agg(F.count("*").alias("n")), "frequency")
    span = F.least(F.size("w"), F.lit(window))
    parts = (
        items.select("ik", "w", F.explode(F.sequence(F.lit(0), F.size("w") - span)).alias("s"))
        .select("ik", "s", F.posexplode(F.slice("w", F.col("s") + 1, span)).alias("j", "word"))
        .select("ik", "s", (F.col("s") + F.col("j")).alias("p"), F.hash("word").alias("term"))
    )
    return (
        keyed_join(parts, frequency, [("term", "counted")], ["ik", "p"]).groupBy("ik", "s")
        .agg(
            F.array_sort(F.collect_list(F.struct("n", "p"))).alias("by_n"),
            F.count(F.when(F.col("n").isNull(), 1)).alias("unknown"),
        )
        .filter("unknown = 0")
        .select("ik", F.slice(F.col("by_n.p"), 1, rarest).alias("set"))
        .groupBy("ik")
        .agg(F.collect_set("set").alias("sets"))
    )


def lists(items: DataFrame, index: DataFrame, places: DataFrame) -> DataFrame:
    """Posting lists of item positions ``(ik, p)``, less their offsets: ``(doc_id, th, ik, p, diagonal)``."""
    known = items.select(F.col("ik").alias("of"), "w")
    looked_up = keep(
        keyed_join(places, known, [("ik", "of")], ["ik", "p"], "inner", salts=1)
        .select(F.hash(F.get("w", F.col("p"))).alias("anchor"), F.struct("ik", "p").alias("x"))
        .groupBy("anchor")
        .agg(F.collect_list("x").alias("at")),
        "anchors",
    )
    return (
        keyed_join(index, looked_up, [("term", "anchor")], ["doc_id", "pos"], "inner")
        .select("doc_id", "th", "pos", F.explode("at").alias("x"))
        .select("doc_id", "th", "x.ik", "x.p", (F.col("pos") - F.col("x.p")).alias("diagonal"))
    )


def band(slop: int) -> Column:
    return F.floor(F.col("diagonal") / F.lit(slop + 1)).cast("long")


def met(items: DataFrame, index: DataFrame, sets: DataFrame, slop: int = 0) -> DataFrame:
    """Lists of all anchors, the more frequent ones only where a window's rarest term is within ``slop``.

    The lists of the rarest terms are short, and only what they reach is taken from the others.  The filter
    goes by a hash; what it lets through in error does not meet later.
    """
    rarest = F.array_distinct(F.transform("sets", lambda s: s[0]))
    others = F.array_except(F.flatten("sets"), rarest)
    first = keep(lists(items, index, sets.select("ik", F.explode(rarest).alias("p"))), "rarest")
    reach = F.array(*[band(slop) + k for k in ((-1, 0, 1) if slop else (0,))])
    near = keep(
        first.select("doc_id", "th", "ik", F.explode(reach).alias("b"))
        .select(F.xxhash64("doc_id", "th", "ik", "b").alias("near")).distinct(),
        "reach",
    )
    rest = lists(items, index, sets.select("ik", F.explode(others).alias("p"))).withColumn(
        "key", F.xxhash64("doc_id", "th", "ik", band(slop))
    )
    reached = keyed_join(rest, near, [("key", "near")], ["p", "diagonal"], "left_semi", limit=0, salts=1).drop("key")
    return keep(first.unionAll(reached), "offsets")


def candidates(offsets: DataFrame, sets: DataFrame) -> DataFrame:
    """``(doc_id, th, ik, diagonal)`` where all rarest terms of some window meet."""
    gathered = offsets.groupBy("doc_id", "th", "ik", "diagonal").agg(F.collect_set("p").alias("ps"))
    known = sets.select(F.col("ik").alias("of"), "sets")
    return (
        keyed_join(gathered, known, [("ik", "of")], ["doc_id", "diagonal"], "inner")
        .filter(F.exists("sets", lambda s: F.size(F.array_except(s, F.col("ps"))) == 0))
        .select("doc_id", "th", "ik", "diagonal")
    )


def near_items(offsets: DataFrame, sets: DataFrame, slop: int = SLOP) -> DataFrame:
    """Proximity matches ``(doc_id, th, ik)``: the rarest terms of a window within ``slop`` of their places.

    Diagonals are dealt into overlapping bands, so that what can match meets in one band.
    """
    banded = (
        offsets.withColumn("band", F.explode(F.array(band(slop), band(slop) - 1)))
        .groupBy("doc_id", "th", "ik", "band")
        .agg(F.collect_set(F.struct("p", "diagonal")).alias("found"))
    )
    known = sets.select(F.col("ik").alias("of"), "sets")
    joined = keyed_join(banded, known, [("ik", "of")], ["doc_id", "band"], "inner").filter(
        F.exists("sets", lambda s: F.size(F.array_except(s, F.col("found.p"))) == 0)
    )

    def fits(s: Column) -> Column:
        return F.exists("found", lambda x: F.forall(s, lambda p: F.exists("found", lambda y: (
            (y["p"] == p) & (y["diagonal"] >= x["diagonal"]) & (y["diagonal"] <= x["diagonal"] + slop)
        ))))

    return joined.filter(F.exists("sets", fits)).select("doc_id", "th", "ik").distinct()


def _covered(w: Column, found: Column, window: int) -> Column:
    """Document positions inside the occurring windows of one candidate; ``w`` are the document's words."""
    n = F.size(found["w"])
    span = F.least(n, F.lit(window))
    equal = F.transform(found["w"], lambda x, j: F.coalesce(F.get(w, found["diagonal"] + j) == x, F.lit(False)))
    return F.transform(
        F.array(equal),
        lambda same: F.flatten(F.transform(
            F.filter(
                F.sequence(F.lit(0), n - span),
                lambda s: ~F.array_contains(F.slice(same, s + 1, span), F.lit(False)),
            ),
            lambda s: F.sequence(found["diagonal"] + s, found["diagonal"] + s + span - 1),
        )),
    )[0]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    near: bool = False,
) -> DataFrame:
    """The rows of ``docs`` with ``n_words``, ``n_hit``, ``items`` and, asked for, ``near_items``.

    ``items`` are the ids, as sorted texts, of items with a window in the document; ``near_items`` those
    with a proximity match, exact ones included.  Columns of ``docs`` keep their names, and a result
    whose name is taken gets an underscore.
    """
    items = keep(item_words(benchmark), "items")
    index = keep(postings(docs, items, id_col, text_col), "postings")
    sets = keep(anchors(items, index, window), "sets")
    offsets = met(items, index, sets, SLOP if near else 0)
    th, did, dth, found, nid, nth, w, hits = fresh(
        docs, "_th", "_d_id", "_d_th", "_found", "_n_id", "_n_th", "_w", "_hits"
    )
    n_words, n_hit, names, close = fresh(docs, "n_words", "n_hit", "items", "near_items")
    known = items.select(F.col("ik").alias("of"), "item", "w")
    hit = keep(
        keyed_join(candidates(offsets, sets), known, [("ik", "of")], ["doc_id", "diagonal"], "inner")
        .groupBy(F.col("doc_id").alias(did), F.col("th").alias(dth))
        .agg(F.collect_list(F.struct("item", "w", "diagonal")).alias(found)),
        "candidates",
    )
    rows = docs.withColumn(th, text_hash(text_col))
    # Hits grow with the documents; their keys are a row's own, so none is copied.
    joined = keyed_join(rows, hit, [(id_col, did), (th, dth)], [id_col, th], salts=1)
    if near:
        nearby = keep(
            keyed_join(near_items(offsets, sets), known, [("ik", "of")], ["doc_id"], "inner")
            .groupBy(F.col("doc_id").alias(nid), F.col("th").alias(nth))
            .agg(F.array_sort(F.collect_set("item")).alias(close)),
            "near",
        )
        joined = keyed_join(joined, nearby, [(id_col, nid), (th, nth)], [id_col, th], salts=1)
    # The array of one binds the words, so that they are split once.
    matched = F.transform(
        F.array(words(F.col(text_col))),
        lambda x: F.struct(
            F.size(x).alias("n"),
            F.filter(
                F.transform(
                    F.coalesce(F.col(found), F.array().cast(hit.schema[found].dataType)),
                    lambda c: F.struct(c["item"].alias("item"), _covered(x, c, window).alias("at")),
                ),
                lambda c: F.size(c["at"]) > 0,
            ).alias("hits"),
        ),
    )
    out = joined.withColumn(hits, matched[0])
    empty = F.array().cast("array<string>")
    return out.select(
        *docs.columns,
        F.col(hits)["n"].cast("long").alias(n_words),
        F.size(F.array_distinct(F.flatten(F.col(hits)["hits"]["at"]))).cast("long").alias(n_hit),
        F.array_sort(F.array_distinct(F.col(hits)["hits"]["item"])).alias(names),
        *([F.coalesce(F.col(close), empty).alias(close)] if near else []),
    )
