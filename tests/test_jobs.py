import json

from postwatch.__main__ import arguments, run
from postwatch.plans import partials, store
from postwatch.sources import transaction


def test_from_messages_to_the_store(spark, post, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    posts = [post("1", "the flu season", ["x"]), post("2", "zika", status="1"),
             post("3", "flu", created_at="Wed Oct 17 03:30:00 +0000 2018")]
    (inbox / "a.txt").write_text("\n".join(map(json.dumps, posts)))
    (tmp_path / "stops.txt").write_text("THE\nAND\n")
    common = ["--stop-words", str(tmp_path / "stops.txt")]
    folder, redone, kept = (str(tmp_path / n) for n in ("tables", "redone", "store"))
    run(spark, arguments(["ingest", "--messages", str(inbox), "--once", "--checkpoint",
                          str(tmp_path / "check"), "--tables", folder, "--rollups", str(tmp_path / "rollups"), *common]))
    run(spark, arguments(["replay", "--raw", f"{folder}/raw_tweet", "--tables", redone, *common]))
    for name in ("tb_tweet", "tb_user", "tb_keyword", "tb_hashtag"):
        a, b = (spark.read.parquet(f"{f}/{name}").drop("batch_id") for f in (folder, redone))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    for times in ([], ["--to", "2018-10-17 00:00:00 -0400"],
                  ["--from", "2018-10-16 00:00:00 -0400", "--to", "2018-10-17 00:00:00 -0400"]):
        run(spark, arguments(["rollup", "--tables", folder, "--store", kept, *times]))
    rows = store.read_store(spark, kept, "keywords").collect()
    got = sorted((r["window_end"].strftime("%d %H"), r["keyword_text"], r["mentions"]) for r in rows)
    assert got == [("16 04", "flu", 1), ("16 04", "season", 1), ("17 04", "flu", 1)]
    totals = store.read_store(spark, kept, "tweet_count").orderBy("window_end").collect()
    assert [r["tcount"] for r in totals] == [1, 0, 0, 0, 1]
    # What was counted while the messages came in is the same.
    run(spark, arguments(["compact", "--rollups", str(tmp_path / "rollups")]))
    assert len(transaction.visible(str(tmp_path / "rollups"))) == 1
    counted = partials.read(spark, str(tmp_path / "rollups"), "keywords").collect()
    assert sorted((r["window_end"].strftime("%d %H"), r["keyword_text"], r["mentions"]) for r in counted) == got
