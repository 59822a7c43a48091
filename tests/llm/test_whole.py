"""The whole job on small inputs on which a shorter way loses something."""

import random

from pyspark.sql import functions as F

from postwatch.llm import linededup, registry


def test_line_dedup_against_all_earlier_documents(spark):
    from postwatch.llm.linededup import MIN_CHARS, Earlier

    registry.ship(spark)
    rng = random.Random(3)
    long = [f"{c} " * 35 + "." for c in "PQLMN"]
    short = [f"{c} short line, of thirty points" for c in "abc"] + ["", "}"]
    texts = [[long[0], long[1]], [long[1], long[0]], [long[1], long[0]]]
    texts += [[long[2], long[3], long[2]], [long[3], long[2], long[3]], [long[3], long[2], long[3]]]
    texts += [[long[4]], [long[4], "tail"], ["new", long[4], "tail"]]
    texts += [rng.choices(long + short, k=rng.randint(1, 7)) for _ in range(150)]
    want = {}
    for d, own in enumerate(texts):
        gone = set()
        for there in texts[:d]:
            gone |= set(Earlier(there, list(map(len, there))).blocks(own, list(map(len, own)), MIN_CHARS))
        want[d] = "\n".join(x for i, x in enumerate(own) if i not in gone)
    docs = spark.createDataFrame([(d, "\n".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.dedupe_lines(docs).collect()} == want
    assert want[1] in long[:2] and want[2] == want[5] == "" and want[8] == "new"
