"""Holders of runs are numbered, so that a round meets as many rows as it tries pairs."""

from postwatch.llm import linededup, registry


def test_numbered_holders(spark):
    registry.ship(spark)
    held = spark.createDataFrame(
        [(d, d * 10, h) for h, n in ((5, 400), (6, 3), (-7, 1), (8, 50)) for d in range(n)] + [(None, 1, 5)], "doc_id long, th long, h long"
    ).repartition(7)
    left = held.filter("h <> 8").select("doc_id", "th", "h")
    numbered, starts = linededup.numbered_holders(held, left)
    numbers = {r["number"]: r["first"] for r in numbered.collect()}
    assert sorted(numbers) == list(range(404))
    begin = {r["of"]: r["start"] for r in starts.collect()}
    for h, n in ((5, 400), (6, 3), (-7, 1)):
        assert sorted(numbers[begin[h] + k] for k in range(n)) == list(range(n))


def test_a_run_in_all_documents_that_no_alignment_takes(spark):
    """Three long lines in changing orders: every document is tried with all earlier ones."""
    import random

    registry.ship(spark)
    rng = random.Random(5)
    long = [f"{c} " * 35 + "." for c in "PQL"]
    texts = [[rng.choice(long) for _ in range(12)] for _ in range(60)]
    want = {}
    for d, own in enumerate(texts):
        gone = set()
        for there in texts[:d]:
            if there != own:
                gone |= set(linededup.Earlier(there, list(map(len, there))).blocks(own, list(map(len, own)), linededup.MIN_CHARS))
            else:
                gone = set(range(len(own)))
                break
        want[d] = "\n".join(x for i, x in enumerate(own) if i not in gone)
    docs = spark.createDataFrame([(d, "\n".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.dedupe_lines(docs).collect()} == want
