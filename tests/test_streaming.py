import json

from pyspark.sql import functions as F

from postwatch.functions import clock
from postwatch.plans import ingest as plan
from postwatch.sources import messages
from postwatch.streaming import ingest, rollup


def at(day, hour):
    return f"Tue Oct {day:02d} {hour:02d}:00:00 +0000 2018"


def send(folder, name, records):
    folder.mkdir(exist_ok=True)
    lines = [r if isinstance(r, str) else json.dumps(r) for r in records]
    (folder / name).write_text("\n".join(lines) + "\n")


def timed(stream):
    posts = messages.good(messages.decode(stream))
    return posts.select("id_str", clock.parse_created_at(F.col("created_at")).alias("ts"))


def test_ingest_is_exactly_once_over_restarts(spark, post, stop_words, tmp_path):
    inbox, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    settings = plan.Settings(["flu"], stop_words)

    def run():
        stream = messages.stream_from_files(spark, str(inbox), max_files=1)
        ingest.start_ingest(stream, settings, out, check, once=True).awaitTermination()
        return {n: spark.read.parquet(f"{out}/{n}").count()
                for n in ("raw_tweet", "tweet", "tb_user", "tb_hashtag", "tb_tweet", "tb_keyword")}

    send(inbox, "a.txt", [post("1", "flu here", ["x", "y"]), post("2", "influence"), "{bad",
                          post("3", "flu", status="1")])
    first = run()
    assert first == {"raw_tweet": 2, "tweet": 2, "tb_user": 2, "tb_hashtag": 2, "tb_tweet": 1, "tb_keyword": 2}
    assert run() == first
    send(inbox, "b.txt", [post("4", "the flu")])
    second = run()
    assert second["tb_user"] == 3 and second["tb_tweet"] == 2
    assert spark.read.parquet(f"{out}/bad_message").count() == 1


def test_windows_close_and_late_posts_are_left_out(spark, post, tmp_path):
    inbox, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        counted = rollup.window_counts(timed(messages.stream_from_files(spark, str(inbox))))
        ingest.start_copy(counted, out, check, once=True).awaitTermination()
        shown = spark.read.parquet(out).withColumn("window_end", F.date_format("window_end", "dd HH"))
        return sorted((r["window_end"], r["mentions"]) for r in shown.collect())

    send(inbox, "a.txt", [post("1", created_at=at(16, 1)), post("2", created_at=at(16, 2)),
                          post("3", created_at=at(16, 14))])
    assert run() == [("16 06", 2)]
    # Two days later, and one that belongs to a closed window.
    send(inbox, "b.txt", [post("4", created_at=at(18, 14)), post("5", created_at=at(16, 3))])
    assert run() == [("16 06", 2), ("16 18", 1)]


def test_repeated_ids_are_dropped_over_restarts(spark, post, tmp_path):
    inbox, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        distinct = rollup.distinct_posts(timed(messages.stream_from_files(spark, str(inbox))))
        ingest.start_copy(distinct, out, check, once=True).awaitTermination()
        return sorted(r["id_str"] for r in spark.read.parquet(out).collect())

    send(inbox, "a.txt", [post("1", created_at=at(16, 1)), post("1", created_at=at(16, 1)), post("2", created_at=at(16, 1))])
    assert run() == ["1", "2"]
    send(inbox, "b.txt", [post("1", created_at=at(16, 1)), post("3", created_at=at(16, 2))])
    assert run() == ["1", "2", "3"]


def test_publish_takes_posts_with_extended_text(spark, post, tmp_path):
    inbox, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    send(inbox, "a.txt", [post("1", "x"), post("2", extended=False)])
    posts = messages.good(messages.decode(messages.stream_from_files(spark, str(inbox))))
    ingest.start_publish(posts, out, check, once=True).awaitTermination()
    got = messages.good(messages.decode(spark.read.text(out))).collect()
    assert [r["id_str"] for r in got] == ["1"]
