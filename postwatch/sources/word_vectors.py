"""Word-vector text files: a word and its numbers on each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.functions import text as X
from postwatch.operators import features

# Columns that give the place of a line in its file or files.
FILE_ORDER = ["file", "block", "line"]


def read_vector_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(word, vec)`` and the place of the line; a part that is no number becomes null."""
    parts = X.tokenize(F.col("value"))
    return (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
            parts.alias("parts"),
        )
        .filter(F.size("parts") > 0)
        .select(
            *FILE_ORDER,
            F.element_at("parts", 1).alias("word"),
            F.transform(
                F.slice("parts", F.lit(2), F.size("parts")), lambda x: x.try_cast("double")
            ).alias("vec"),
        )
    )


def read_word_vectors(
    spark: SparkSession, path: str, seed: int | None = 11, end_word: bool = True
) -> DataFrame:
    """``(idx, word, vec)`` in file order with the special rows."""
    lines = read_vector_lines(spark, path)
    number = features.with_special_rows if end_word else features.without_special_rows
    return number(lines, FILE_ORDER, seed)


def write_word_vectors(words: DataFrame, path: str, order: str) -> None:
    """Write ``(word, vec)`` as lines in the order of a column."""
    parts = F.transform("vec", lambda x: x.cast("string"))
    words.orderBy(order).select(
        F.concat_ws(" ", "word", F.array_join(parts, " ")).alias("value")
    ).write.text(path)
