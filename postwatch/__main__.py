"""Jobs from the command line: ``spark-submit`` or ``python -m postwatch JOB ...``

    ingest  --messages DIR | --kafka SERVERS --topic T   --checkpoint DIR [--once]
            --stop-words FILE --tables DIR [--terms a,b] [--places DIR] [--max-offsets N] [--max-files N]
            [--rollups DIR]
    replay  --raw DIR --stop-words FILE --tables DIR [--terms a,b] [--places DIR]
    rollup  --tables DIR --store DIR [--from TIME] [--to TIME] [--window]
    compact --rollups DIR

TIME is like ``2018-10-16 00:00:00 -0400``.  A roll-up takes all windows, those from ``--from`` on, those
between both times (or one window between them with ``--window``), or, with ``--to`` alone, the six hours
before it.  With ``--rollups`` an ingest also keeps roll-ups that late posts correct; ``compact`` folds their parts.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from postwatch.functions import clock
from postwatch.functions.words import TERMS, read_words
from postwatch.operators import lookup
from postwatch.plans import ingest, partials, store
from postwatch.session import keep, scratch
from postwatch.sources import messages, transaction
from postwatch.streaming import ingest as stream_ingest


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="postwatch")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("ingest", "replay"):
        job = jobs.add_parser(name)
        job.add_argument("--terms", type=lambda t: t.split(","), default=TERMS)
        job.add_argument("--stop-words", required=True)
        job.add_argument("--tables", required=True)
    jobs.choices["replay"].add_argument("--raw", required=True)
    source = jobs.choices["ingest"].add_mutually_exclusive_group(required=True)
    source.add_argument("--messages")
    source.add_argument("--kafka")
    # The backlog after a long stop is taken in batches of this many messages or files.
    jobs.choices["ingest"].add_argument("--max-offsets", type=int, default=1_000_000)
    jobs.choices["ingest"].add_argument("--max-files", type=int, default=1_000)
    for name in ("ingest", "replay"):
        # A table of places (place, country_code, rank).
        jobs.choices[name].add_argument("--places")
    jobs.choices["ingest"].add_argument("--topic")
    jobs.choices["ingest"].add_argument("--checkpoint", required=True)
    jobs.choices["ingest"].add_argument("--once", action="store_true")
    jobs.choices["ingest"].add_argument("--rollups")
    jobs.add_parser("compact").add_argument("--rollups", required=True)
    job = jobs.add_parser("rollup")
    job.add_argument("--tables", required=True)
    job.add_argument("--store", required=True)
    job.add_argument("--from", dest="start")
    job.add_argument("--to", dest="end")
    job.add_argument("--window", action="store_true")
    return parser.parse_args(argv)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if args.job == "compact":
        partials.compact(spark, args.rollups)
        transaction.vacuum(args.rollups)
        return
    if args.job == "rollup":
        derived = store.read_tables(spark, args.tables)
        start = clock.border(args.start) if args.start else None
        end = clock.border(args.end) if args.end else None
        if start is not None and end is not None and args.window:
            counted = store.one_window(derived, start, end)
        elif start is None and end is not None:
            counted = store.last_window(derived, end)
        else:
            counted = store.backfill(derived, start, end)
        store.update_store(counted, args.store)
        return
    with scratch(spark):
        _ingest(spark, args)


def _ingest(spark: SparkSession, args: argparse.Namespace) -> None:
    places = None
    if args.places:
        places = keep(lookup.best_places(spark.read.parquet(args.places)), "places")
    settings = ingest.Settings(args.terms, read_words(args.stop_words), places)
    if args.job == "replay":
        ingest.replay_tables(spark.read.parquet(args.raw), settings, args.tables)
        return
    if args.kafka:
        stream = messages.stream_from_kafka(spark, args.kafka, args.topic, args.max_offsets)
    else:
        stream = messages.stream_from_files(spark, args.messages, args.max_files)
    stream_ingest.start_ingest(
        stream, settings, args.tables, args.checkpoint, once=args.once, rollups=args.rollups
    ).awaitTermination()


if __name__ == "__main__":
    given = arguments()
    run(SparkSession.builder.appName("postwatch").getOrCreate(), given)
