"""What is shuffled is never broadcast as well, however small its files are."""

import pytest

from pyspark.sql import functions as F

from postwatch.llm import common, decontaminate, linededup, mixing, registry, simhash
from postwatch.session import keep


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled(spark, monkeypatch):
    """Every dictionary counts as too large for a broadcast, and Spark would broadcast all of these."""
    registry.ship(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    monkeypatch.setattr(common, "measured_bytes", lambda df: 1 << 40)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("salts", [1, 32])
def test_a_dictionary_beyond_the_limit_is_not_broadcast(spark, shuffled, salts):
    rows = spark.createDataFrame([(1, 7), (2, 7), (3, None), (4, 9)], "id int, k int")
    words = keep(spark.createDataFrame([(7, "a"), (8, "b"), (None, "c")], "of int, word string"), "words")
    joined = common.keyed_join(rows, words, [("k", "of")], ["id"], salts=salts)
    assert "Broadcast" not in plan_of(joined)
    assert sorted((r["id"], r["word"]) for r in joined.collect()) == [(1, "a"), (2, "a"), (3, "c"), (4, None)]


DOCS = [(None, "A b c d e f g h i j k."), (1, "x a b c d e f g h i j"), (1, "x a b c d e f g h i j"), (2, "nothing here"), (3, None), (4, "a b c X d e f g h i j")]
ITEMS = [(1, "a b c d e f g h i j"), (2, "other words")]
WANT = [(None, 10, ["1"], ["1"]), (1, 10, ["1"], ["1"]), (1, 10, ["1"], ["1"]), (2, 0, [], []), (3, 0, [], []), (4, 0, [], ["1"])]


def test_hits_are_shuffled_without_copies(spark, shuffled):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    found = decontaminate.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), near=True)
    plan = plan_of(found)
    assert "Broadcast" not in plan and "_salt" not in plan
    rows = [(r["doc_id"], r["n_hit"], r["items"], r["near_items"]) for r in found.collect()]
    assert sorted(rows, key=str) == sorted(WANT, key=str)


def test_the_mix_joins_tables_of_blocks_alone(spark, monkeypatch):
    registry.ship(spark)
    sizes, real = [], common.keyed_join
    monkeypatch.setattr(mixing, "keyed_join", lambda rows, dictionary, *more: (sizes.append(dictionary.count()), real(rows, dictionary, *more))[1])
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b"), "id").alias("text"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"), F.lit(7).alias("u")
    )
    mixed = mixing.mix(docs, block_words=500)
    assert max(sizes) <= 100
    # What a document's draws are, told by the plan, which sees the same rows.
    draws = {r["doc_id"]: sorted(tuple(d) for d in r["draws"]) for r in mixing.plan(docs, block_words=500).collect()}
    found = {i: [] for i in draws}
    for r in mixed.collect():
        assert r["u"] == 7
        found[r["doc_id"]].append((r["pass"], r["shard"], r["place"]))
    assert {i: sorted(x) for i, x in found.items()} == draws


def test_pairs_of_tiles_are_not_broadcast(spark, shuffled):
    fps = spark.range(300).select(F.xxhash64("id").alias("fp"))
    plan = plan_of(simhash.links(fps, tile=16))
    assert plan.count("SortMergeJoin") == 2


def test_tries_of_runs_are_not_broadcast(spark, shuffled, monkeypatch):
    plans, real = [], linededup.keep
    monkeypatch.setattr(linededup, "keep", lambda df, name: (plans.append(plan_of(df)) if name == "pairs" else None, real(df, name))[1])
    long = [f"{c} " * 35 + "." for c in "PQ"]
    docs = spark.createDataFrame([(d, "\n".join(long[::-1] if d % 2 else long) + f"\n{d}") for d in range(6)], "doc_id long, text string")
    linededup.dedupe_lines(docs).collect()
    assert len(plans) > 1
    for plan in plans[1:]:
        # One row per partition is broadcast for the numbers.
        assert [x for x in plan.split("\n") if "BroadcastHashJoin" in x and "_part" not in x] == []
