import math
import random

import pytest

from postwatch.operators import ordinal


def numbers(spark, n):
    keys = [k * 7 for k in range(n)]
    random.Random(1).shuffle(keys)
    return spark.createDataFrame([(k, str(k)) for k in keys], "k LONG, payload STRING").repartition(5)


def by_split(df):
    out = {}
    for r in df.orderBy("k").collect():
        out.setdefault(r["split"], []).append(r["k"] // 7)
    return out


def test_ordinal_is_dense_and_ordered(spark):
    rows = ordinal.with_ordinal(numbers(spark, 1000), "k").collect()
    assert sorted((r["k"], r["ordinal"]) for r in rows) == [(i * 7, i) for i in range(1000)]


def test_ordinal_over_several_columns(spark):
    # One value of the first column holds most rows.
    df = spark.createDataFrame([("hot", i) for i in range(300)] + [("a", 1), ("z", 2)], "s STRING, i INT")
    rows = sorted(ordinal.with_ordinal(df.repartition(4), "s", "i").collect(), key=lambda r: r["ordinal"])
    assert [(r["s"], r["i"]) for r in rows] == [("a", 1)] + [("hot", i) for i in range(300)] + [("z", 2)]
    assert [r["ordinal"] for r in rows] == list(range(302))


def test_ten_rows(spark):
    df = numbers(spark, 10)
    assert by_split(ordinal.split_positional(df, "k")) == {
        "test": [0, 1], "valid": [2, 3], "train": [4, 5, 6, 7, 8, 9]}
    assert by_split(ordinal.split_positional(df, "k", compat=True)) == {
        "test": [0, 1], "valid": [3], "train": [5, 6, 7, 8, 9]}


@pytest.mark.parametrize("n", [1, 3, 4, 7, 23])
def test_against_python_lists(spark, n):
    rows, t = list(range(n)), math.floor(n * 0.2)
    df = numbers(spark, n)
    want = {"test": rows[:t], "valid": rows[t + 1:2 * t], "train": rows[2 * t + 1:]}
    assert by_split(ordinal.split_positional(df, "k", compat=True)) == {k: v for k, v in want.items() if v}
    want = {"test": rows[:t], "valid": rows[t:2 * t], "train": rows[2 * t:]}
    assert by_split(ordinal.split_positional(df, "k")) == {k: v for k, v in want.items() if v}
    head = math.ceil(n * 0.6)
    want = {"train": rows[:head], "test": rows[head:]}
    assert by_split(ordinal.split_head(df, "k")) == {k: v for k, v in want.items() if v}
    tail = n - math.floor(n * 0.2)
    want = {"train": rows[:tail], "valid": rows[tail:]}
    assert by_split(ordinal.split_tail(df, "k")) == {k: v for k, v in want.items() if v}


def test_no_rows(spark):
    assert ordinal.split_positional(numbers(spark, 4).limit(0), "k").collect() == []


def test_hash_split_is_stable(spark):
    a = {r["k"]: r["split"] for r in ordinal.split_hash(numbers(spark, 2000), "k").collect()}
    b = {r["k"]: r["split"] for r in ordinal.split_hash(numbers(spark, 1000), "k").collect()}
    assert all(a[k] == s for k, s in b.items())
    assert 300 < sum(s == "valid" for s in a.values()) < 500
