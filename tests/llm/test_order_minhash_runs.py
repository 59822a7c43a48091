"""Long runs without white space in Order MinHash."""

import random

from pyspark.sql import functions as F

from postwatch.llm import ordermin


def test_insertion_at_the_front_of_a_long_run(spark):
    rng = random.Random(1)
    han = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(3000))
    wide = "".join(chr(0x20000 + rng.randrange(2000)) for _ in range(3000))
    code = "".join(rng.choice("abcdef0123456789") for _ in range(3000))
    rows = [(t, x + t) for t, x in ((han, "中"), (wide, "\U00020001"), (code, "x"))]
    like = ordermin.likeness(ordermin.signature(F.col("a")), ordermin.signature(F.col("b")))
    assert all(r[0] > 0.7 for r in spark.createDataFrame(rows, "a string, b string").select(like).collect())
    assert spark.createDataFrame([(han, wide)], "a string, b string").select(like).first()[0] < 0.1


def test_pieces(spark):
    long = "abcdefghijklmn"
    text = f"one two\t{long} three \U00020001{long[:12]} {long[:12]}"
    found = F.regexp_extract_all(F.col("t"), F.lit(ordermin._PIECES), F.lit(1))
    got = spark.createDataFrame([(text,)], "t string").select(found).first()[0]
    assert got == ["one", "two", long[:12], long[1:13], long[2:], "three", "\U00020001" + long[:11], long[:12], long[:12]]
