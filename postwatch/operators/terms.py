"""Large lists of terms, of one word or several, found in texts through a trie that is a table.

A row of the trie is a first stretch of words of some terms: its words, the term that ends there if one does, and
whether longer ones go on from it.  Every word of a text is looked up as a first stretch of one word; only where a
longer one goes on is the stretch with one word more looked up, and so on to the longest term.  No term is an expression
in the plan, so a list can have any number of terms, and a frequent word costs a row of the trie, whatever
the number of terms that begin with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.functions import text as X
from postwatch.operators.lookup import BROADCAST_BYTES, lookup_join
from postwatch.session import keep


def term_words(term: Column) -> Column:
    """Words of a term or a text: lower case, the ignored characters blanked."""
    return F.transform(X.tokenize(X.blank(term, X.TERM_BLANKED)), F.lower)


def term_trie(terms: DataFrame, term: str = "term") -> DataFrame:
    """``(depth, stretch, term, more)`` of a table of terms, stored.

    Terms that have the same words are one, named by the smallest; terms without words are left out.
    """
    words = terms.select(F.col(term).alias("term"), term_words(F.col(term)).alias("words")).filter(F.size("words") > 0)
    stretches = words.select(
        "term", F.size("words").alias("n"), "words", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("depth")
    )
    return keep(
        stretches.withColumn("stretch", F.array_join(F.slice("words", F.lit(1), F.col("depth")), " "))
        .groupBy("depth", "stretch")
        .agg(F.min(F.when(F.col("depth") == F.col("n"), F.col("term"))).alias("term"), F.max(F.col("depth") < F.col("n")).alias("more")),
        "trie",
    )


def term_hits(
    texts: DataFrame, key: Sequence[str], trie: DataFrame, text: str = "text", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """``(key, pos, term)``: every place where the words of a term stand one after the other."""
    longest = trie.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("n")).first()["n"]
    words = texts.select(*key, term_words(F.col(text)).alias("_words"))
    # Each place goes along with as many words as the longest term has.
    ahead = F.transform("_words", lambda _, i: F.slice(F.col("_words"), i + 1, F.lit(max(1, longest))))
    live = words.select(*key, F.posexplode(ahead).alias("pos", "_ahead"))
    found = []
    for depth in range(1, longest + 1):
        level = trie.filter(F.col("depth") == depth).select(F.col("stretch").alias("_stretch"), "term", "more")
        stretch = F.array_join(F.slice("_ahead", F.lit(1), F.lit(depth)), " ")
        rows = live.filter(F.size("_ahead") >= depth).withColumn("_stretch", stretch)
        hit = lookup_join(rows, level, "_stretch", [*key, "pos"], "inner", limit)
        if depth < longest:
            # What goes on is looked at twice, by this level and by the next.
            hit = keep(hit, "hits")
        found.append(hit.filter(F.col("term").isNotNull()).select(*key, "pos", "term"))
        live = hit.filter("more").select(*key, "pos", "_ahead")
    if not found:
        return live.select(*key, "pos", F.lit("").alias("term")).limit(0)
    out = found[0]
    for part in found[1:]:
        out = out.unionAll(part)
    return out


def with_terms(
    posts: DataFrame, key: Sequence[str], trie: DataFrame, text: str = "text", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """``(key, term)``: the terms of each text, each once."""
    return term_hits(posts, key, trie, text, limit).select(*key, "term").distinct()


def having_terms(
    posts: DataFrame, key: Sequence[str], trie: DataFrame, text: str = "text", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """The texts that have any of the terms; ``key`` is unique."""
    return posts.join(term_hits(posts, key, trie, text, limit).select(*key).distinct(), list(key), "left_semi")
