"""Partial counts, late rows, and writes of several tables in one transaction."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from postwatch import schemas
from postwatch.plans import ingest, partials, store
from postwatch.sources import messages, transaction
from postwatch.streaming import rollup as stream_rollup

START = dt.datetime(2018, 10, 16)


def derived(spark, rows):
    """Derived tables of ``(hours, id, user, name, term)``."""
    data = [(START + dt.timedelta(hours=h), i, u, n, t) for h, i, u, n, t in rows]
    df = spark.createDataFrame(data, "ts timestamp, id_tweet string, id_user string, screen_name string, term string")
    return {
        "tb_tweet": df.select("ts", F.col("term").alias("disease")),
        "tb_keyword": df.select("ts", F.upper("term").alias("keyword")),
        "tb_hashtag": df.filter("term <> 'flu'").select("ts", F.col("term").alias("hashtag")),
        "tb_user": df.select("ts", "id_tweet", "id_user", "screen_name", F.lit(None).cast("string").alias("location")),
    }


def some(n, seed=0):
    rng = random.Random(seed)
    return [(rng.randint(0, 40), str(i), rng.choice("uvw"), f"name{i}", rng.choice(["flu", "zika", "cold"])) for i in range(n)]


def shown(rows):
    return sorted(map(tuple, rows.collect()), key=str)


def expected(spark, rows):
    return {
        name: shown(df.select("window_end", *(c for c in df.columns if c != "window_end")))
        for name, df in store.backfill(derived(spark, rows)).items()
    }


def in_order(spark, folder):
    found = {}
    for name in partials.STORES:
        df = partials.read(spark, folder, name)
        found[name] = shown(df.select("window_end", *(c for c in df.columns if c != "window_end")))
    return found


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1, 2), (1, 1, 0, 2, 0)])
def test_any_order_and_repeats_equal_one_batch(spark, tmp_path, order):
    rows, folder = some(60), str(tmp_path / "store")
    for i, batch in enumerate(order):
        if i == 2:
            partials.compact(spark, folder)
        partials.add(derived(spark, rows[batch::3]), folder, f"b{batch}")
    assert in_order(spark, folder) == expected(spark, rows)


def test_a_late_post_corrects_its_window(spark, tmp_path):
    folder = str(tmp_path / "store")
    early = [(1, "5", "u", "first", "flu"), (13, "6", "u", "later", "flu")]
    partials.add(derived(spark, early), folder, "a")
    before = in_order(spark, folder)
    partials.add(derived(spark, [(0, "9", "u", "older", "flu")]), folder, "late")
    after = in_order(spark, folder)
    first = START + dt.timedelta(hours=4)
    assert [r for r in before["disease"] if r[0] == first] == [(first, "flu", 1)]
    assert [r for r in after["disease"] if r[0] == first] == [(first, "flu", 2)]
    assert [r[2] for r in after["users"] if r[0] == first] == ["older"]
    # Windows without rows in between are there with a 0.
    assert [r[1] for r in sorted(after["tweet_count"])] == [2, 0, 1]


def test_folded_batches_are_not_counted_again(spark, tmp_path):
    folder, rows = str(tmp_path / "store"), some(30)
    partials.add(derived(spark, rows[:15]), folder, "a")
    partials.add(derived(spark, rows[15:]), folder, "b")
    want = in_order(spark, folder)
    assert partials.compact(spark, folder) == 2
    assert transaction.vacuum(folder) == 2
    assert not partials.add(derived(spark, rows[:15]), folder, "a")
    assert in_order(spark, folder) == want and len(transaction.visible(folder)) == 1
    # What is folded can be folded again, and the batches stay known.
    partials.add(derived(spark, some(5, 1)), folder, "c")
    partials.compact(spark, folder)
    transaction.vacuum(folder)
    assert not partials.add(derived(spark, rows[:15]), folder, "b")


def test_an_empty_store_and_empty_batches(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert all(rows == [] for rows in in_order(spark, folder).values())
    partials.add(derived(spark, []), folder, "none")
    assert all(rows == [] for rows in in_order(spark, folder).values())
    assert partials.compact(spark, folder) == 1 and transaction.vacuum(folder) == 0


def files_below(folder):
    return [f for _, _, names in os.walk(folder) for f in names if f.endswith(".parquet")]


def test_a_failed_task_leaves_the_store_as_it_was(spark, tmp_path):
    folder, schema = str(tmp_path / "store"), "store string, n long"
    good = spark.range(40).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("store"), F.col("id").alias("n"))
    transaction.write(good, folder, "one")
    before, files = shown(transaction.read(spark, folder, "a", schema)), files_below(folder)
    # One task of eight fails, at its last row, when others have written.
    late = F.when(F.col("id") == 7999, F.raise_error(F.lit("stopped"))).otherwise(F.col("id"))
    bad = spark.range(0, 8000, 1, 8).select(F.lit("a").alias("store"), late.cast("long").alias("n"))
    for label in ("one", "two"):
        with pytest.raises(Exception, match="stopped"):
            transaction.write(bad, folder, label)
        assert shown(transaction.read(spark, folder, "a", schema)) == before
        assert files_below(folder) == files and list(transaction.visible(folder)) == ["one"]
    transaction.write(good.limit(4), folder, "one")
    assert transaction.read(spark, folder, "a", schema).count() + transaction.read(spark, folder, "b", schema).count() == 4
    # Tasks that were still running when the write failed may have left files that nobody sees.
    assert transaction.vacuum(folder) == 1
    transaction.vacuum(folder, orphans_after=0)
    assert len(os.listdir(f"{folder}/data")) == 1
    assert transaction.read(spark, folder, "a", schema).count() > 0


def test_all_stores_come_at_once(spark, tmp_path):
    """What readers see is one manifest, so they see all stores of a write or none."""
    folder = str(tmp_path / "store")
    partials.add(derived(spark, some(20)), folder, "a")
    entry, = transaction.manifests(folder)
    assert {name for name, _ in entry["files"]} == set(partials.STORES)
    os.rename(entry["path"], entry["path"] + ".aside")
    assert all(rows == [] for rows in in_order(spark, folder).values())


def test_stream_of_late_posts(spark, tmp_path, post):
    times = ["03:30:00", "11:00:00", "03:50:00", "23:00:00"]
    records = [post(id_str=str(i), text=f"flu day{i}", created_at=f"Tue Oct 16 {t} +0000 2018", hashtags=["x"]) for i, t in enumerate(times)]
    sent = spark.createDataFrame(records, schemas.POST)
    settings = ingest.Settings(terms=["flu"], stop_words=[])
    source, folder = str(tmp_path / "in"), str(tmp_path / "store")
    for i in range(len(times)):
        messages.encode(sent.filter(F.col("id_str") == str(i))).coalesce(1).write.mode("append").text(source)
    stream = messages.stream_from_files(spark, source, max_files=1)
    stream_rollup.start_rollups(stream, settings, folder, str(tmp_path / "c"), once=True).awaitTermination()
    assert len(transaction.visible(folder)) == len(times)
    tables = ingest.six_tables(sent, settings)
    want = store.backfill({name: tables[name] for name in store.TABLES})
    for name in partials.STORES:
        got = partials.read(spark, folder, name)
        assert shown(got.select(*sorted(got.columns))) == shown(want[name].select(*sorted(got.columns))), name
