"""Vocabularies, index sequences, sentence matrices, bag of words, unknown words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwatch.functions import arrays as A
from postwatch.functions import text as X
from postwatch.operators.lookup import BROADCAST_BYTES, lookup_join
from postwatch.operators.ordinal import with_ordinal
from postwatch.session import keep

# The two special rows of a word-vector table.
END_WORD = "<EOF>"
UNKNOWN_WORD = "<unk>"

# A counted vocabulary gives 1 to unknown words and has this size by default.
OOV_INDEX = 1
NUM_WORDS = 10000


def fit_vocabulary(texts: DataFrame, text: str = "text") -> DataFrame:
    """``(word, idx, n)`` of all words of the bag-of-words tokenizer, in the order of falling counts.

    Index 0 is the padding, 1 the unknown word, words count from 2.  Words of equal count go by the
    alphabet, as rows have no order of first appearance.  Words are counted before the shuffle, and
    ranked by range, so no task sees all of them.  ``kept_words`` bounds what texts are mapped to.
    """
    counted = (
        texts.select(F.explode(X.tokenizer_parts(F.col(text))).alias("word"))
        .filter(F.col("word") != "")
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )
    # The ranges are found from a sample of the counts, so these are stored and the texts read once.
    counted = keep(counted, "counted")
    ranked = with_ordinal(counted.withColumn("falling", -F.col("n")), "falling", "word")
    first = OOV_INDEX + 1
    return keep(ranked.select("word", (F.col("ordinal") + first).cast("int").alias("idx"), "n"), "vocabulary")


def kept_words(vocabulary: DataFrame, num_words: int) -> DataFrame:
    """The words whose index is below ``num_words``; the others count as unknown when texts are mapped."""
    return vocabulary.filter(F.col("idx") < num_words)


def with_special_rows(words: DataFrame, order: list[str], seed: int | None = 11) -> DataFrame:
    """Number a table ``(word, vec)``: ``<EOF>`` with zeros is 0, words follow, ``<unk>`` is last.

    The unknown word gets a vector from the hash of ``seed``, the same in every run, or zeros for
    ``seed=None``.
    """
    numbered = with_ordinal(words, *order).select(
        (F.col("ordinal") + 1).alias("idx"), "word", "vec"
    )
    zero = F.transform("vec", lambda _: F.lit(0.0))
    unknown = zero
    if seed is not None:
        unknown = F.transform(
            "vec", lambda _, i: F.pmod(F.xxhash64(F.lit(seed), i), F.lit(1 << 20)) / (1 << 20)
        )
    # The shape of the vectors comes from one of the rows.
    ends = numbered.agg(F.max("idx").alias("last"), F.max_by("vec", "idx").alias("vec"))
    first = ends.select(F.lit(0).cast("long").alias("idx"), F.lit(END_WORD).alias("word"),
                        zero.alias("vec"))
    last = ends.select((F.col("last") + 1).alias("idx"), F.lit(UNKNOWN_WORD).alias("word"),
                       unknown.alias("vec"))
    return numbered.unionByName(first).unionByName(last)


def without_special_rows(words: DataFrame, order: list[str], seed: int | None = 11) -> DataFrame:
    """The older numbering: words count from 0, there is no ``<EOF>``, ``<unk>`` is last."""
    numbered = with_special_rows(words, order, seed).filter(F.col("idx") > 0)
    return numbered.withColumn("idx", F.col("idx") - 1)


def word_index(vocabulary: DataFrame) -> DataFrame:
    """``(word, idx)``, unique in the word; of a repeated word the last place counts."""
    return vocabulary.groupBy("word").agg(F.max("idx").cast("int").alias("idx"))


def _token_rows(texts: DataFrame, key: list[str], text: str, tokens) -> DataFrame:
    """One row per word and its place; a text without words keeps one row with a null word.

    The compact texts are shuffled by their key first, so the words of a text are together already when
    they are regrouped behind a broadcast dictionary.  The number of partitions is given, as their size is that of the
    texts and not that of the words behind the explode: left to itself, adaptive execution joins them into few.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = texts.select(*key, text).repartition(parts, *key)
    return placed.select(*key, F.posexplode_outer(tokens).alias("pos", "word"))


def _indices(rows: DataFrame, key: list[str], unknown: int) -> DataFrame:
    """Put looked-up words back together in order, one array per text.

    Place and index share one long number, place first: this is what is shuffled per word, and it
    sorts as it is.
    """
    idx = F.coalesce("idx", F.lit(unknown)).cast("long")
    packed = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(idx)
    low = F.lit((1 << 32) - 1)
    return rows.groupBy(*key).agg(
        F.transform(
            F.sort_array(F.collect_list(packed)), lambda p: p.bitwiseAND(low).cast("int")
        ).alias("indices")
    )


def sentence_to_indices(
    texts: DataFrame,
    key: list[str],
    index: DataFrame,
    unknown: int,
    text: str = "text",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(key, indices)``: each white-space word by its index, unseen words by ``unknown``.

    ``index`` is ``(word, idx)``, unique in the word.  ``key`` is unique per text, so a regrouped
    array is no longer than its text.
    """
    rows = _token_rows(texts, key, text, X.tokenize(F.col(text)))
    return _indices(lookup_join(rows, index, "word", [*key, "pos"], "left", limit), key, unknown)


def texts_to_sequences(
    texts: DataFrame,
    key: list[str],
    vocabulary: DataFrame,
    text: str = "text",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """The same with the tokenizer and the numbering of ``fit_vocabulary``."""
    rows = _token_rows(texts, key, text, X.tokenizer_words(F.col(text)))
    index = vocabulary.select("word", "idx")
    return _indices(lookup_join(rows, index, "word", [*key, "pos"], "left", limit), key, OOV_INDEX)


def binary_bag_of_words(sequences: DataFrame) -> DataFrame:
    """The set positions of each text's 0/1 word vector, ascending."""
    positions = F.array_sort(F.array_distinct("indices"))
    return sequences.withColumn("positions", positions).drop("indices")


def sentence_to_matrix(
    texts: DataFrame,
    key: list[str],
    vectors: DataFrame,
    unknown: int,
    max_len: int,
    text: str = "text",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(key, matrix)``: one vector per word, filled up with zero rows to ``max_len``.

    ``vectors`` is ``(idx, word, vec)`` with an ``unknown`` row.  A text without words gives zero
    rows only.
    """
    table = vectors.select("idx", "word", "vec")
    last = table.groupBy("word").agg(F.max_by(F.struct("idx", "vec"), "idx").alias("e"))
    index = keep(last.select("word", "e.vec"), "vectors")
    fallback = table.filter(F.col("idx") == unknown).select("vec").first()["vec"]
    unseen = F.array(*[F.lit(float(x)) for x in fallback])
    zeros = F.array_repeat(F.lit(0.0), len(fallback))
    rows = _token_rows(texts, key, text, X.tokenize(F.col(text)))
    found = lookup_join(rows, index, "word", [*key, "pos"], "left", limit)
    pair = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("vec", unseen).alias("vec")))
    matrix = F.transform(F.sort_array(F.collect_list(pair)), lambda p: p["vec"])
    return found.groupBy(*key).agg(matrix.alias("matrix")).withColumn(
        "matrix", A.pad(F.col("matrix"), max_len, zeros)
    )


def max_tokens(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row: the greatest number of words, and the even number it is padded to."""
    longest = texts.agg(
        F.coalesce(F.max(F.size(X.tokenize(F.col(text)))), F.lit(0)).alias("max_len")
    )
    return longest.withColumn("padded_len", A.even(F.col("max_len")))


def padded_length(texts: DataFrame, text: str = "text") -> int:
    return max_tokens(texts, text).first()["padded_len"]


def longest_text(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The text of most characters; of several the one with the smallest key."""
    size = F.struct(F.length(text), -F.col(key))
    return texts.filter(F.length(text) > 0).agg(
        F.max_by(F.struct(key, text, F.length(text).alias("n_chars")), size).alias("t")
    ).select("t.*")


def token_lengths(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    return texts.select(key, F.size(X.tokenize(F.col(text))).alias("n_tokens"))


def unknown_words(
    texts: DataFrame,
    key: str,
    index: DataFrame,
    text: str = "text",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(key, pos, word)`` of the words that the vocabulary lacks."""
    rows = texts.select(key, F.posexplode(X.tokenize(F.col(text))).alias("pos", "word"))
    return lookup_join(rows, index.select("word"), "word", [key, "pos"], "left_anti", limit)


def unknown_per_text(unknown: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Of every text: its unknown words in order, and how many they are; no words and 0 where all are known."""
    words = F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda p: p["word"])
    found = unknown.groupBy(key).agg(
        F.array_join(words, " ").alias("words"), F.count("*").alias("n_unknown")
    )
    return texts.select(key).join(found, key, "left").select(
        key, F.coalesce("words", F.lit("")).alias("words"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown")
    )


def unknown_totals(unknown: DataFrame) -> DataFrame:
    """All and distinct unknown words.

    Words are first counted where they are, so what is shuffled is one row per word and task.
    """
    per_word = unknown.groupBy("word").agg(F.count("*").alias("n"))
    return per_word.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct_words")
    )


def term_dimension(rows: DataFrame, term: str) -> DataFrame:
    """``(id, term)``: every distinct term once with a dense id from 1, in the order of terms."""
    distinct = rows.select(term).distinct()
    return with_ordinal(distinct, term).select((F.col("ordinal") + 1).alias("id"), term)


def with_term_ids(
    pairs: DataFrame, key: str, term: str, dimension: DataFrame, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Add to ``(key, term)`` pairs the ``id`` of the term.

    ``dimension`` should be a stored table, as its size is measured first.
    """
    return lookup_join(pairs, dimension, term, [key], "inner", limit)


def term_bridge(
    pairs: DataFrame, key: str, term: str, dimension: DataFrame, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """``(key, id)`` rows that link keys to their terms, from distinct ``(key, term)`` pairs."""
    return with_term_ids(pairs, key, term, dimension, limit).select(key, "id")
