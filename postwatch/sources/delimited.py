"""Delimited text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwatch import schemas
from postwatch.functions import text as X


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    sep: str = ",",
    header: bool = False,
    encoding: str = "UTF-8",
) -> DataFrame:
    """Rows of a delimited file; a quote inside a quoted field is doubled.

    A record is one line, so large files are read by many tasks.
    """
    return spark.read.csv(
        path, schema=schema, sep=sep, header=header, encoding=encoding, quote='"', escape='"',
        enforceSchema=True,
    )


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = False) -> None:
    df.write.csv(
        path, sep=sep, header=header, quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def read_labeled(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    header: bool = False,
    encoding: str = "UTF-8",
    schema: T.StructType = schemas.LABELED_TEXT,
) -> DataFrame:
    """Labelled texts: the first field stripped, the others as integers, null if they are none."""
    rows = read_delimited(spark, path, schema, sep, header, encoding)
    text, *labels = schema.fieldNames()
    return rows.select(
        X.strip(F.coalesce(F.col(text), F.lit(""))).alias(text),
        *[X.strip(F.col(c)).try_cast("int").alias(c) for c in labels],
    )


def convert(
    spark: SparkSession,
    source: str,
    target: str,
    columns: int,
    sep: str,
    new_sep: str,
    wanted: Sequence[int] | None = None,
) -> None:
    """Write a delimited file anew with another delimiter, with all or the ``wanted`` columns."""
    names = [f"c{i}" for i in range(columns)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = read_delimited(spark, source, schema, sep)
    if wanted is not None:
        rows = rows.select(*[names[i] for i in wanted])
    write_delimited(rows, target, new_sep)


def json_lines_to_delimited(spark: SparkSession, source: str, sep: str = "|") -> DataFrame:
    """Lines ``id|full_text`` of all records of a JSON-lines file.

    Line breaks inside a text become spaces, so that a record stays one line.
    """
    return spark.read.schema(schemas.JSON_TEXT).json(source).select(
        F.concat_ws(sep, F.col("id").cast("string"), X.blank(F.col("full_text"), "\r\n")).alias("value")
    )


def clean_labeled(spark: SparkSession, source: str, target: str) -> None:
    """Write a ``text|label`` file anew as ``cleaned text,label``."""
    rows = read_delimited(spark, source, schemas.LABELED_TEXT, "|")
    write_delimited(rows.withColumn("tweet", X.clean_text(F.col("tweet"))), target, ",")
