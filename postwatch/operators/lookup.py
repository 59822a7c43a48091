"""Joins of large row sets with dictionaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwatch.functions import text as X
from postwatch.session import keep

# A dictionary above this estimate is not broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32
#: Keys that are spread at most; they are found in one of ``SEEN`` rows, where they occur ``LEAST_SEEN`` times at least.
HOT_KEYS = 1000
SEEN = 64
LEAST_SEEN = 16


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows in memory, estimated from one aggregation over them."""
    row = F.lit(16)
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            row = row + F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.NumericType):
            row = row + 8 * F.greatest(F.size(field.name), F.lit(0)) + 16
        elif isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            # Nested values: their text, doubled for the offsets and sizes of their parts.
            row = row + 2 * F.coalesce(F.octet_length(F.to_json(field.name)), F.lit(0)) + 32
        else:
            row = row + 8
    return df.agg(F.coalesce(F.sum(row.cast("long")), F.lit(0)).alias("b")).first()["b"]


def _salted(rows: DataFrame, dictionary: DataFrame, key: str, spread: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``_salt``: rows of hot keys, and nulls, get one of ``SALTS``, and hot dictionary rows are there per salt.

    Which keys are hot is seen in a part of the rows; it decides where rows meet, and not which.
    """
    part = rows.filter(F.col(key).isNotNull() & (F.pmod(F.xxhash64(*spread), F.lit(SEEN)) == 0))
    often = part.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= LEAST_SEEN)
    # Stored, as both sides must agree on it.
    top = often.orderBy(F.desc("_n"), key).limit(HOT_KEYS).select(key, F.lit(True).alias("_hot"))
    hot = F.broadcast(keep(top, "hot"))
    # Other bits of the hash than those that picked the part.
    salt = F.pmod(F.shiftright(F.xxhash64(*spread), 16), F.lit(SALTS)).cast("int")
    spread_out = F.col("_hot").isNotNull() | F.col(key).isNull()
    salted = rows.join(hot, key, "left").withColumn("_salt", F.when(spread_out, salt).otherwise(0)).drop("_hot")
    salts = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted, dictionary.join(hot, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")


def lookup_join(
    rows: DataFrame,
    dictionary: DataFrame,
    key: str,
    spread: Sequence[str],
    how: str = "left",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``rows`` with a ``dictionary`` that is unique in ``key``; also as a ``left_anti`` join.

    The dictionary should be a stored table, as its size is measured first.  Up to ``limit``
    bytes it is broadcast and the rows stay where they are.  Beyond, both sides are shuffled by
    the key and a salt: the rows of a hot key (nulls too) spread over ``SALTS`` tasks by the hash
    of their ``spread`` columns, and its dictionary row is there once per salt; all other rows are there once.
    """
    if measured_bytes(dictionary) <= limit:
        return rows.join(F.broadcast(dictionary), key, how)
    salted, copies = _salted(rows, dictionary, key, spread)
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def location_key(location):
    """Normal form of a free-text location: lower case, no punctuation, single spaces."""
    words = X.tokenize(F.translate(F.lower(location), X.PUNCTUATION.replace("_", ""), ""))
    return F.array_join(words, " ")


def best_places(candidates: DataFrame) -> DataFrame:
    """One country code per location key, of ``(place, country_code, rank)``: the lowest rank.

    Ties go to the smaller code.  Candidates of a place meet as partial minima, so a place with
    very many of them is no hot spot.
    """
    return (
        candidates.withColumn("location_key", location_key(F.col("place")))
        .groupBy("location_key")
        .agg(F.min(F.struct("rank", "country_code"))["country_code"].alias("country_code"))
    )


def enrich_location(users: DataFrame, places: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Replace the users' own location text by a country code, null where none is known."""
    keyed = users.withColumn("location_key", location_key(F.col("location")))
    joined = lookup_join(keyed, places, "location_key", ["id_tweet"], "left", limit)
    return joined.withColumn("location", F.col("country_code")).select(*users.columns)


def place_candidates(location) -> Column:
    """What a location such as ``city, region, country`` may name, the most exact first.

    The whole of it, then without its first part, and so on; behind these the parts in front alone, from the longest:
    ``city, region``, ``city``.  Each is in the normal form of ``location_key``; empty parts do not count.
    """
    parts = F.filter(F.transform(F.split(location, ","), location_key), lambda p: p != "")
    n = F.size(parts)
    places = F.when(n > 0, F.sequence(F.lit(1), n))
    suffixes = F.transform(places, lambda i: F.array_join(F.slice(parts, i, n - i + 1), " "))
    fronts = F.transform(F.filter(places, lambda i: i < n), lambda i: F.array_join(F.slice(parts, F.lit(1), n - i), " "))
    return F.array_distinct(F.concat(suffixes, fronts))


def locate(
    users: DataFrame, key: Sequence[str], places: DataFrame, location: str = "location", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """``(key, country_code, matched, tried)``: the best place of every location, null where none is known.

    All candidates of all locations go through one join, salted if the gazetteer is large; of those that are known the
    first one counts.  ``places`` is what ``best_places`` gives.  ``tried`` is the candidate's number, from 1.
    """
    candidates = users.select(*key, F.posexplode_outer(place_candidates(F.col(location))).alias("_at", "location_key"))
    known = lookup_join(candidates, places, "location_key", [*key, "_at"], "left", limit)
    first = F.min(F.when(F.col("country_code").isNotNull(), F.struct("_at", "location_key", "country_code")))
    return known.groupBy(*key).agg(first.alias("_p")).select(
        *key, F.col("_p.country_code").alias("country_code"), F.col("_p.location_key").alias("matched"),
        (F.col("_p._at") + 1).alias("tried"),
    )
