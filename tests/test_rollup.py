import datetime as dt

from pyspark.sql import functions as F

from postwatch.functions import clock
from postwatch.operators import posts as P
from postwatch.operators import rollup
from postwatch.plans import store
from postwatch.sources import tables


def rows(spark, *times):
    data = [(t, "a" if i % 2 else "b") for i, t in enumerate(times)]
    df = spark.createDataFrame(data, "t STRING, term STRING")
    return df.withColumn("ts", F.to_timestamp("t"))


def shown(df, *columns):
    out = df.withColumn("window_end", F.date_format("window_end", "yyyy-MM-dd HH:mm"))
    return sorted(tuple(r[c] for c in ("window_end", *columns)) for r in out.collect())


def test_window_ends(spark):
    df = rows(spark, "2018-10-16 03:30:00")
    assert shown(rollup.counts(df, day_start=clock.DAY_START)) == [("2018-10-16 04:00",)]
    assert shown(rollup.counts(df)) == [("2018-10-16 06:00",)]
    # The start belongs to the window, the end does not.
    assert shown(rollup.counts(rows(spark, "2018-10-16 06:00:00"))) == [("2018-10-16 12:00",)]


def test_sum_over_windows_is_the_total(spark):
    df = rows(spark, *[f"2018-10-16 {h:02d}:59:00" for h in range(24)])
    got = rollup.counts(df, "term").agg(F.sum("mentions")).first()[0]
    assert got == 24


def test_zero_filled(spark):
    df = rows(spark, "2018-10-16 00:00:00", "2018-10-16 00:01:00", "2018-10-16 19:00:00")
    got = shown(rollup.zero_filled(rollup.counts(df, n="tcount")), "tcount")
    assert got == [("2018-10-16 06:00", 2), ("2018-10-16 12:00", 0), ("2018-10-16 18:00", 0),
                   ("2018-10-17 00:00", 1)]


def test_zero_filled_of_nothing(spark):
    df = rows(spark, "2018-10-16 00:00:00").filter("term = 'x'")
    assert rollup.zero_filled(rollup.counts(df, n="tcount")).collect() == []


def test_ranges_are_half_open(spark):
    df = rows(spark, "2018-10-16 04:00:00", "2018-10-16 09:59:59", "2018-10-16 10:00:00")
    end = clock.border("2018-10-16 06:00:00 -0400")
    assert rollup.in_last_window(df, end).count() == 2
    assert rollup.in_range(df, clock.border("2018-10-16 10:00:00 +0000"), end + F.expr("INTERVAL 1 HOUR")).count() == 1


def test_users_show_their_earliest_names(spark):
    df = spark.createDataFrame(
        [("2", "u", "late", "L"), ("1", "u", "early", None), ("3", "v", "x", "Y")],
        "id_tweet STRING, id_user STRING, screen_name STRING, location STRING",
    ).withColumn("ts", F.to_timestamp(F.lit("2018-10-16 01:00:00")))
    got = shown(rollup.user_counts(df), "id_user", "user_name", "user_location", "mentions")
    assert got == [("2018-10-16 06:00", "u", "early", None, 2), ("2018-10-16 06:00", "v", "x", "Y", 1)]


def test_sink_replaces_windows_it_gets_again(spark, tmp_path):
    path = str(tmp_path / "r")
    first = rollup.counts(rows(spark, "2018-10-16 01:00:00", "2018-10-16 07:00:00"), "term")
    tables.write_rollup(first, path)
    tables.write_rollup(first, path)
    assert spark.read.parquet(path).count() == 2
    more = rollup.counts(rows(spark, "2018-10-16 07:00:00", "2018-10-16 08:00:00"), "term")
    tables.write_rollup(more, path)
    assert shown(spark.read.parquet(path), "term", "mentions") == [
        ("2018-10-16 06:00", "b", 1), ("2018-10-16 12:00", "a", 1), ("2018-10-16 12:00", "b", 1)]


def test_store(spark, posts, post, stop_words, tmp_path):
    df = posts(
        post("1", "flu and zika", ["h"], user="7"),
        post("2", "the flu", ["h", "g"], created_at="Tue Oct 16 20:00:00 +0000 2018", user="8"),
    )
    ts = clock.parse_created_at(F.col("timestamp"))
    tb = {
        "tb_tweet": P.tagged_posts(df, ["zika", "flu"]), "tb_user": P.user_rows(df),
        "tb_keyword": P.keyword_rows(df, stop_words), "tb_hashtag": P.hashtag_rows(df),
    }
    derived = {k: v.withColumn("ts", ts) for k, v in tb.items()}
    counted = store.backfill(derived)
    store.update_store(counted, str(tmp_path))
    read = {n: store.read_store(spark, str(tmp_path), n) for n in counted}
    assert shown(read["tweet_count"], "tcount") == [
        ("2018-10-16 04:00", 2), ("2018-10-16 10:00", 0), ("2018-10-16 16:00", 0), ("2018-10-16 22:00", 1)]
    assert shown(read["disease"], "disease_name", "mentions") == [
        ("2018-10-16 04:00", "flu", 1), ("2018-10-16 04:00", "zika", 1), ("2018-10-16 22:00", "flu", 1)]
    assert shown(read["hashtags"], "hashtag_text", "mentions") == [
        ("2018-10-16 04:00", "h", 1), ("2018-10-16 22:00", "g", 1), ("2018-10-16 22:00", "h", 1)]
    assert shown(read["users"], "id_user", "user_name") == [
        ("2018-10-16 04:00", "7", "s7"), ("2018-10-16 22:00", "8", "s8")]
    assert read["keywords"].count() == 3
    assert isinstance(read["disease"].first()["window_end"], dt.datetime)

    # A range of windows; one window of any length; the six hours before a time.
    day = [clock.border(f"2018-10-16 {h:02d}:00:00 -0400") for h in (0, 18)]
    assert shown(store.backfill(derived, *day)["tweet_count"], "tcount") == [
        ("2018-10-16 10:00", 0), ("2018-10-16 16:00", 0), ("2018-10-16 22:00", 1)]
    wide = [clock.border(f"2018-10-{d} 00:00:00 -0400") for d in (20, 22)]
    assert [n for _, n in shown(store.backfill(derived, *wide)["tweet_count"], "tcount")] == [0] * 8

    # A window that has lost its rows is empty after a re-run, the others stay.
    fewer = {n: rows.filter("ts < '2018-10-16 12:00:00'") for n, rows in derived.items()}
    late = [clock.border(f"2018-10-16 {h:02d}:00:00 -0400") for h in (12, 18)]
    store.update_store(store.backfill(fewer, *late), str(tmp_path))
    after = {n: store.read_store(spark, str(tmp_path), n) for n in counted}
    assert shown(after["tweet_count"], "tcount") == [
        ("2018-10-16 04:00", 2), ("2018-10-16 10:00", 0), ("2018-10-16 16:00", 0), ("2018-10-16 22:00", 0)]
    assert shown(after["disease"], "disease_name") == [("2018-10-16 04:00", "flu"), ("2018-10-16 04:00", "zika")]
    assert after["keywords"].filter("window_end > '2018-10-16 20:00:00'").count() == 0
    window = store.one_window(derived, clock.border("2018-10-15 23:00:00 -0400"), day[0])
    assert shown(window["tweet_count"], "tcount") == [("2018-10-16 04:00", 2)]
    assert shown(window["hashtags"], "hashtag_text", "mentions") == [("2018-10-16 04:00", "h", 1)]
    last = store.last_window(derived, clock.border("2018-10-17 00:00:00 -0400"))
    assert shown(last["tweet_count"], "tcount") == [("2018-10-17 04:00", 0)]
    assert last["users"].count() == 0


def test_windows_without_rows_read_the_rows_once(spark):
    from tests.test_catalog import explained

    df = rows(spark, "2018-10-16 01:00:00")
    plan = explained(rollup.zero_filled(rollup.counts(df, n="tcount")))
    assert plan.count("Scan ExistingRDD (") == 1 or plan.count("LocalTableScan (") == 1
