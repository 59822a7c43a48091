"""From raw documents to a training mix, in five stages.

Each stage is written as Parquet and read again as the next one's documents; all but the last return the
columns of ``documents``.

1. ``language_id``: documents without a language, and those of which no language holds half of the letters, go.
2. ``line_dedup``: blocks of lines that an earlier document has are deleted; ``n_chars`` follows the text.
3. ``simhash``: one document of each group of near-duplicates stays.  Near duplicates are those of the operator: fingerprints of
   three-word shingles that differ in at most three bits.
4. ``decontamination``: documents that hold a window of a benchmark item go.
5. ``mixing``: documents are drawn by source to the target weights, a row per draw, dealt over shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.llm import decontaminate, langid, linededup, mixing, simhash
from postwatch.llm.common import fresh
from postwatch.llm.registry import ship, table
from postwatch.session import new_folder, remove, scratch

#: Share of the letters that the text's language must have.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = langid.fit(docs, "lang", "text", by=F.col("doc_id"))
    label, score = fresh(docs, "lang_pred", "score")
    found = langid.identify(docs, model)
    return found.filter((F.col(label) != langid.NO_LABEL) & (F.col(score) >= LEAST_SHARE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    out = linededup.dedupe_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.dedupe(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    n_hit = fresh(docs, "n_words", "n_hit")[1]
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.col(n_hit) == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
]

#: SQL cannot express the first three stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix.  What a stage has kept for itself is removed when it has been written, and its input with it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            folder = new_folder(spark, name)
            out.write.parquet(folder)
        docs = spark.read.schema(out.schema).parquet(folder)
        if before is not None:
            remove(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
