"""From posts to the six tables, in batch and per micro-batch."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwatch.functions import clock
from postwatch.operators import lookup
from postwatch.operators import posts as P
from postwatch.plans import partials
from postwatch.session import keep, scratch
from postwatch.sources import messages, tables


@dataclass(frozen=True)
class Settings:
    """What the tables depend on."""

    terms: Sequence[str]
    stop_words: Sequence[str]
    # (location_key, country_code), unique in the key; None leaves the users' own text.
    places: DataFrame | None = None


# Tables whose rows carry the record time ``ts``.
TIMED = {"tb_tweet", "tb_user", "tb_hashtag", "tb_keyword"}


def six_tables(posts: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """All tables of a set of posts.  Retweets are dropped first.

    The timed tables also get the record time as a timestamp ``ts``, parsed once per post.
    """
    own = P.drop_retweets(posts)
    timed = own.withColumn("ts", clock.parse_created_at(F.col("created_at")))
    users = P.user_rows(timed, ["ts"])
    if settings.places is not None:
        users = lookup.enrich_location(users, settings.places)
    return {
        "raw_tweet": messages.raw_rows(own),
        "tweet": P.flat_posts(P.containing_terms(own, settings.terms)),
        "tb_user": users,
        "tb_hashtag": P.hashtag_rows(timed, ["ts"]),
        "tb_tweet": P.tagged_posts(timed, settings.terms, ["ts"]),
        "tb_keyword": P.keyword_rows(timed, settings.stop_words, ["ts"]),
    }


def write_tables(
    tables_: dict[str, DataFrame], folder: str, batch_id: int, whole: bool = False
) -> None:
    """Write tables below ``folder``; the same batch again replaces its rows, ``whole`` all batches.

    The tables do not depend on each other, so their jobs run side by side and the last tasks of one
    overlap with the first of the next.  If one fails, the call fails.
    """

    def write(name: str) -> None:
        time = "ts" if name in TIMED else None
        tables.write_batch(tables_[name], f"{folder}/{name}", batch_id, time, whole)

    spark = next(iter(tables_.values())).sparkSession
    with ThreadPoolExecutor(len(tables_)) as pool:
        # Threads must belong to the stream's job group, hence one target per thread.
        jobs = [pool.submit(inheritable_thread_target(spark)(write), name) for name in tables_]
    for job in jobs:
        job.result()


def ingest_batch(
    decoded: DataFrame, settings: Settings, folder: str, batch_id: int, rollups: str | None = None
) -> None:
    """Write all tables of a batch of decoded messages; what is no record goes to ``bad_message``.

    With ``rollups`` the batch also adds its partial counts to that store.  The batch feeds all these writers, so it
    is kept for the time of the call.
    """
    decoded = decoded.persist()
    try:
        if not decoded.isEmpty():
            bad = decoded.select(messages.BAD).filter(f"{messages.BAD} IS NOT NULL")
            tables.write_batch(bad, f"{folder}/bad_message", batch_id)
            derived = six_tables(messages.good(decoded), settings)
            write_tables(derived, folder, batch_id)
            if rollups is not None:
                partials.add(derived, rollups, f"stream-{batch_id}")
    finally:
        decoded.unpersist()


def replay_tables(raw: DataFrame, settings: Settings, folder: str) -> None:
    """Derive the timed tables anew from the raw landing table, in place of all that is in them.

    It may write where an ingest wrote: what the ingest derived from the same records is replaced.

    The records are parsed once and stored by column, for the time of the call; each table then reads only
    what it needs.
    """
    with scratch(raw.sparkSession):
        derived = six_tables(keep(messages.replay(raw), "posts"), settings)
        write_tables({name: derived[name] for name in sorted(TIMED)}, folder, 0, whole=True)
