"""Array functions: padding, one-hot labels, arg-max, vectors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the three classes.
LABEL_NAMES = {0: "negative", 1: "positive", 2: "neutral"}


def pad(array: Column, length: Column | int, filler: Column | int = 0) -> Column:
    """Append ``filler`` up to ``length``; longer arrays stay as they are."""
    length = F.lit(length) if isinstance(length, int) else length
    filler = F.lit(filler) if isinstance(filler, int) else filler
    missing = F.greatest(length - F.size(array), F.lit(0)).cast("int")
    return F.concat(array, F.array_repeat(filler, missing))


def trim(array: Column, length: Column | int) -> Column:
    """The first ``length`` elements."""
    return F.slice(array, F.lit(1), F.lit(length) if isinstance(length, int) else length)


def even(n: Column) -> Column:
    """``n``, or the even number after it."""
    return n + F.pmod(n, F.lit(2))


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == label, 1).otherwise(0)
    )


def argmax(scores: Column) -> Column:
    """0-based place of the greatest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def label_name(label: Column, names: Mapping[int, str] = LABEL_NAMES) -> Column:
    """Name of a class, null for an unknown one."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(table, label)


def binary_label(label: Column) -> Column:
    """Three classes to two: class 2 counts as class 0."""
    return F.when(label == 2, 0).otherwise(label)


def dot(u: Column, v: Column) -> Column:
    products = F.zip_with(u, v, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(u: Column, v: Column) -> Column:
    """Cosine of the angle between two vectors, null when one of them is zero."""
    return F.try_divide(dot(u, v), norm(u) * norm(v))
