import json

import pytest
from pyspark.sql import functions as F

from postwatch import schemas, session
from postwatch.functions import clock
from postwatch.operators import ordinal
from postwatch.plans import ingest
from postwatch.sources import delimited, messages, tables, word_vectors


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_decode_keeps_bad_messages_apart(spark, post):
    sent = [json.dumps(post("1", "flu", ["x"])), "{broken", json.dumps({"id_str": "2"})]
    decoded = messages.decode(spark.createDataFrame([(s,) for s in sent], "value STRING"))
    assert decoded.columns == [*schemas.POST.fieldNames(), messages.SOURCE, messages.BAD]
    assert [r["id_str"] for r in messages.good(decoded).orderBy("id_str").collect()] == ["1", "2"]
    bad = decoded.filter(F.col(messages.BAD).isNotNull()).collect()
    assert [r[messages.BAD] for r in bad] == ["{broken"]


def test_no_message_is_lost(spark, stop_words, post, tmp_path):
    """Every message is landed, a retweet, or set aside; what is landed is the text as it came."""
    whole = json.dumps({**post("1", "flu"), "coordinates": [1.5, 2], "retweet_count": 3})
    unmarked = json.dumps({"id_str": "2"})
    sent = [whole, unmarked, json.dumps(post("3", status="1")), "{}", "", None, "[1]", "{broken"]
    decoded = messages.decode(spark.createDataFrame([(s,) for s in sent], "value STRING"))
    ingest.ingest_batch(decoded, ingest.Settings(["flu"], stop_words), str(tmp_path), 0)
    landed = [r["json"] for r in spark.read.parquet(f"{tmp_path}/raw_tweet").collect()]
    assert sorted(landed) == sorted([whole, unmarked])
    bad = [r[messages.BAD] for r in spark.read.parquet(f"{tmp_path}/bad_message").collect()]
    assert sorted(bad) == ["", "", "[1]", "{broken", "{}"]
    published = messages.encode(messages.good(decoded)).collect()
    assert whole in [r["value"] for r in published]


def test_replay_into_the_tables_of_an_ingest(spark, stop_words, post, tmp_path):
    settings = ingest.Settings(["flu"], stop_words)
    for batch in range(3):
        sent = [json.dumps(post(str(batch), "the flu season", ["x"]))]
        decoded = messages.decode(spark.createDataFrame([(s,) for s in sent], "value STRING"))
        ingest.ingest_batch(decoded, settings, str(tmp_path), batch)
    before = {n: spark.read.parquet(f"{tmp_path}/{n}").count() for n in ingest.TIMED}
    ingest.replay_tables(spark.read.parquet(f"{tmp_path}/raw_tweet"), settings, str(tmp_path))
    after = {n: spark.read.parquet(f"{tmp_path}/{n}").count() for n in ingest.TIMED}
    assert before == after == {"tb_tweet": 3, "tb_user": 3, "tb_hashtag": 3, "tb_keyword": 6}


def test_records_survive_the_round_trip(posts, post):
    df = posts(post("1", "a \"quote\"\n—é", ["x", "y"], location="L"), post("2", extended=False))
    back = messages.good(messages.decode(messages.encode(df))).drop(messages.SOURCE)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_raw_rows_replay(posts, post):
    df = posts(post("1", "flu", ["x"]), post("2", status="1"))
    raw = messages.raw_rows(df)
    assert raw.columns == ["twitter_id", "json", "inserted_tweet"]
    assert sorted(map(str, messages.replay(raw).drop(messages.SOURCE).collect())) == sorted(map(str, df.collect()))


def test_publish_round(posts, post):
    df = posts(*[post(f"{i:03d}", "t", extended=i % 2 == 0) for i in range(30)])
    got = messages.publish_round(df, ["id_str"], cap=10).collect()
    assert [r["key"] for r in got] == [f"{i:03d}" for i in range(0, 20, 2)]
    assert json.loads(got[0]["value"])["extended_tweet"]["full_text"] == "t"


def test_labeled_file(spark, tmp_path):
    text = 'tweet,label\n" a, ""b""\xa0",1\nc, 2 \nd,none\n,0\n'
    path = write(tmp_path / "a.csv", text)
    got = delimited.read_labeled(spark, path, header=True).collect()
    assert [tuple(r) for r in got] == [('a, "b"', 1), ("c", 2), ("d", None), ("", 0)]
    assert delimited.read_labeled(spark, path).count() == 5


def test_latin_file(spark, tmp_path):
    path = write(tmp_path / "a.csv", "café|1\n", "iso-8859-1")
    assert tuple(delimited.read_labeled(spark, path, "|", encoding="ISO-8859-1").first()) == ("café", 1)


def test_judged_file(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a b|1|0\n c |2|2\n")
    got = delimited.read_labeled(spark, path, "|", schema=schemas.JUDGED_TEXT).collect()
    assert [tuple(r) for r in got] == [("a b", 1, 0), ("c", 2, 2)]


def test_convert(spark, tmp_path):
    source = write(tmp_path / "a.txt", '"x y" 1 2\nz 3 4\n')
    target = str(tmp_path / "b")
    delimited.convert(spark, source, target, 3, " ", "|")
    assert sorted(r["value"] for r in spark.read.text(target).collect()) == ["x y|1|2", "z|3|4"]
    delimited.convert(spark, target, str(tmp_path / "c"), 3, "|", ",", wanted=[0, 2])
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "c")).collect()) == ["x y,2", "z,4"]


def test_clean_labeled(spark, tmp_path):
    source = write(tmp_path / "a.csv", "I can't stop! #Flu|1\n@me, see http://x.y now|0\n")
    delimited.clean_labeled(spark, source, str(tmp_path / "b"))
    got = sorted(r["value"] for r in spark.read.text(str(tmp_path / "b")).collect())
    assert got == ["i cannot stop flu,1", "see  now,0"]


def test_json_lines_keep_every_record(spark, tmp_path):
    lines = [json.dumps({"id": i, "full_text": f"t\n{i}"}) for i in range(5)]
    path = write(tmp_path / "a.json", "\n".join(lines) + "\n")
    got = sorted(r["value"] for r in delimited.json_lines_to_delimited(spark, path).collect())
    assert got == [f"{i}|t {i}" for i in range(5)]


def test_word_vectors(spark, tmp_path):
    path = write(tmp_path / "v.txt", "the 0.5 -1\ncat 1e-3 2\n\nbad x 3\n")
    rows = word_vectors.read_word_vectors(spark, path, seed=None).orderBy("idx").collect()
    assert [tuple(r) for r in rows] == [
        (0, "<EOF>", [0.0, 0.0]), (1, "the", [0.5, -1.0]), (2, "cat", [0.001, 2.0]),
        (3, "bad", [None, 3.0]), (4, "<unk>", [0.0, 0.0])]


def test_word_vectors_of_a_large_file_keep_their_order(spark, tmp_path):
    path = write(tmp_path / "v.txt", "".join(f"w{i} {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = word_vectors.read_word_vectors(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {r["idx"]: r["word"] for r in rows}
    assert all(got[i + 1] == f"w{i}" for i in range(5000)) and len(rows) == 5002


def test_append_table(spark, posts, post):
    raw = messages.raw_rows(posts(post("1")))
    tables.append_table(raw, "posts_test", "raw_tweet")
    tables.append_table(raw, "posts_test", "raw_tweet")
    assert spark.table("posts_test.raw_tweet").count() == 2


def test_a_batch_written_again_replaces_itself(spark, posts, post, tmp_path):
    path = str(tmp_path / "t")
    df = posts(post("1"), post("2", created_at="Wed Oct 17 03:30:00 +0000 2018"), post("3", created_at="?"))
    rows = df.select("id_str", clock.parse_created_at(F.col("created_at")).alias("ts"))
    for batch in (0, 0, 1):
        tables.write_batch(rows, path, batch, "ts")
    stored = spark.read.parquet(path)
    assert stored.count() == 6
    assert stored.filter("event_date = '2018-10-17'").select("id_str").distinct().first()[0] == "2"


def test_kept_tables_go_with_their_block(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    from postwatch.session import keep, scratch

    outer = keep(spark.range(2), "outer")
    with scratch(spark):
        kept = keep(spark.range(3), "inner")
        file = Path(urlparse(kept.inputFiles()[0]).path)
        assert kept.count() == 3 and file.exists()
    assert not file.parent.exists() and outer.count() == 2


def test_replay_twice_gives_the_same_tables(spark, posts, post, stop_words, tmp_path):
    raw = messages.raw_rows(posts(post("1", "flu season", ["a"]), post("2", "zika", status="1")))
    settings = ingest.Settings(["flu", "zika"], stop_words)
    for _ in range(2):
        ingest.replay_tables(raw, settings, str(tmp_path))
        counts = {n: spark.read.parquet(f"{tmp_path}/{n}").count() for n in ingest.TIMED}
        assert counts == {"tb_tweet": 1, "tb_user": 1, "tb_hashtag": 1, "tb_keyword": 2}


def test_splits(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("k"), F.array("id", F.col("id") + 1).alias("a"))
    tables.write_splits(ordinal.split_positional(df, "k"), str(tmp_path / "s"))
    got = tables.read_split(spark, str(tmp_path / "s"), "valid").orderBy("k").collect()
    assert [(r["k"], r["a"]) for r in got] == [(2, [2, 3]), (3, [3, 4])]


class Cluster:
    """As much of a session as the folder needs."""

    def __init__(self, named):
        self.conf = self
        self.sparkContext = type("C", (), {"master": "spark://host:7077"})
        self.named = named

    def get(self, key, default):
        return self.named if key == "spark.checkpoint.dir" else default


def test_shared_folder_comes_from_the_session():
    assert session.shared_folder(Cluster("hdfs://shared/")) == "hdfs://shared"
    with pytest.raises(RuntimeError):
        session.shared_folder(Cluster(None))
