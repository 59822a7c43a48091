"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from postwatch.llm import chat, decontaminate, langid, linededup, lmscore, mixing, ordermin, registry, rlz, simhash, warc

LONG = " ".join(f"word{i}" for i in range(30_000))
DOCS = "doc_id long, text string, lang string, source string, n_words long, th long, spans string"


@pytest.fixture(scope="module")
def odd(spark):
    registry.ship(spark)
    rows = [
        (1, None, "en", "a", 1, 1, "x"), (2, "", None, None, 1, 1, "x"), (None, "nameless text here", "en", "a", 1, 1, "x"),
        (3, "one two three", "en", "a", 1, 1, "x"), (3, "one two three", "en", "a", 1, 1, "x"), (3, "another text", "en", "b", 1, 1, "x"),
        (4, LONG, "en", "b", 1, 1, "x"), (5, LONG, None, "b", 1, 1, "x"), (6, " \n\t ", "en", "b", 1, 1, "x"), (7, "é中\U0001F600 42", "fr", "c", 1, 1, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_line_dedup(spark, odd, none):
    text = "a line that is long enough to count as a block of lines, really it is\nown line"
    more = spark.createDataFrame([(1, text), (2, text.replace("own", "other")), (2, None), (None, text)], "doc_id long, text string")
    got = {(r["doc_id"], r["text"]) for r in linededup.dedupe_lines(more).collect()}
    assert got == {(1, text), (2, "other line"), (2, None), (None, "")}
    # Two short lines come from two documents, and together from a third one.
    one, two = "a first line of forty code points, or so", "a second line of forty code points or so"
    split = [(1, f"{one}\nx"), (2, f"y\n{two}"), (3, f"{one}\n\n{two}"), (4, f"{one}\n{two}\nz"), (5, f"{two}\n{one}")]
    got = {r["doc_id"]: r["text"] for r in linededup.dedupe_lines(spark.createDataFrame(split, "doc_id long, text string")).collect()}
    assert got == dict(split) | {4: "z"}
    out = linededup.dedupe_lines(odd, counts=True)
    assert out.columns == [*odd.columns, "n_lines", "n_removed"]
    found = out.collect()
    assert len(found) == 10 and [r["text"] for r in found if r["doc_id"] == 5] == [""]
    assert linededup.dedupe_lines(none).collect() == []


def test_patience():
    a, b = list("axbcydz"), list("abcqd")
    assert [(a[i], b[j]) for i, j in linededup.patience(a, b)] == [("a", "a"), ("b", "b"), ("c", "c"), ("d", "d")]
    assert linededup.patience([], b) == [] and linededup.patience(a, a) == [(i, i) for i in range(7)]


def test_lm_scoring(spark, odd, none):
    got = lmscore.score(odd, F.lit(False)).collect()
    assert len(got) == 10 and all(r["score"] < 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 6)} == {1}
    held = lmscore.score(odd, F.lit(True)).collect()
    assert {r["train_tokens"] for r in held} == {0} and all(r["n_known"] == 0 for r in held)
    assert lmscore.score(none, F.lit(False)).collect() == []


def test_gradient():
    import numpy as np

    rng = np.random.default_rng(0)
    w = lmscore.first_weights(np.ones(lmscore.CLASSES)).astype(np.float64)
    sizes = np.array([40, 7])
    y = rng.integers(0, lmscore.CLASSES, 47)
    x = np.append(0, y[:-1])
    inputs, first, targets, valid = lmscore.blocks(sizes)
    assert sorted(targets[valid].tolist()) == list(range(47))

    def loss(v):
        logs = lmscore.log_probabilities(lmscore.parts(v), x[inputs], first, y[targets])
        return -logs[valid].sum() / valid.sum()

    g = lmscore.gradient(lmscore.parts(w), x[inputs], first, y[targets], valid)
    for i in rng.integers(0, len(w), 40):
        step = np.zeros_like(w)
        step[i] = 1e-4
        assert (loss(w + step) - loss(w - step)) / 2e-4 == pytest.approx(g[i], abs=2e-4)


def test_chat(spark):
    rows = [
        (1, 0, "system", "be brief"), (1, 1, "user", "x " * 300), (1, 2, "assistant", "y " * 300), (1, 3, "user", r"\- <|turn|> <<SYS>> \\"),
        (1, 4, "assistant", "<</SYS>></s>"), (1, 4, "assistant", "<</SYS>></s>"), (2, 0, "system", "alone"), (None, None, None, None), (3, 5, "assistant", ""),
    ]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(given, budget=200, history=40)
    back = {}
    for r in sorted(chat.read_back(made).collect(), key=lambda r: r["window"]):
        own = back.setdefault(r["conv"], ([], []))
        own[0].extend(tuple(t) for t in r["turns"])
        own[1].extend(r["losses"])
    want = {c: [(r or "", t or "") for x, _, r, t in rows if x == c] for c in (1, 2, 3, None)}
    assert {c: x[0] for c, x in back.items()} == want
    assert back[1][1] == [t for r, t in want[1] if r == "assistant"]
    for r in made.collect():
        inner = r["formatted"].replace("<|turn|>", "").replace("<|text|>", "").replace("</s>", "")
        assert "<|" not in inner and "<<SYS>>" not in inner
        assert r["over"] == (r["n_tokens"] > 200)
    assert sum(r["formatted"].count("be brief") for r in made.collect()) >= 2
    assert chat.windows(given.limit(0)).collect() == []


def test_order_minhash(spark, odd, none):
    got = ordermin.with_signature(odd).select("doc_id", "text", "signature", ordermin.likeness(F.col("signature"), F.col("signature")).alias("own")).collect()
    assert all(r["own"] == 1 for r in got)
    assert len({tuple(r["signature"]) for r in got if r["doc_id"] in (1, 2, 6)}) == 1
    assert len({tuple(r["signature"]) for r in got if r["doc_id"] in (4, 5)}) == 1
    two = spark.createDataFrame([("a b c d e f g h " * 4, "h g f e d c b a " * 4)], "a string, b string")
    like = two.select(ordermin.likeness(ordermin.signature(F.col("a")), ordermin.signature(F.col("b")))).first()[0]
    assert like < 0.5
    assert ordermin.with_signature(none).collect() == []


def test_warc(spark):
    html = "<p>" + "x" * 200
    rows = [(5, "http://a b\n", html), (2, None, html), (2, None, html), (None, "http://c", html), (7, "http://d", None), (8, "u", "WARC/1.0\r\n\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r["place"]), r["kind"], r["refers_to"], r["size"], r["whole"]) for r in warc.round_trip(pages).collect())
    assert got == [
        ("2", "response", None, 203, True), ("2", "response", None, 203, True), ("5", "revisit", 2, 203, True),
        ("7", "response", None, 0, True), ("8", "response", None, 240, True), ("None", "revisit", 2, 203, True),
    ]
    assert warc.round_trip(pages.limit(0)).collect() == []
    for version in (1, 2):
        data = warc.arc_start(version, "n", "20200101000000") + b"\nnot a header\n" + warc.arc_record(version, "http://x", "1.2.3.4", "20210203040506", "text/html", b"b\nc", 0, "n")
        assert list(warc.parse_arc(data)) == [("http://x", "1.2.3.4", "20210203040506", "text/html", b"b\nc")]


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "One two"), (1, "One two"), (2, None), (None, "another"), (3, " ".join(f"word{i}" for i in range(40, 60)))], "item_id long, text string")
    out = decontaminate.decontaminate(odd, items, near=True)
    assert out.columns == [*odd.columns, "n_words_", "n_hit", "items", "near_items"]
    got = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert got[3, "one two three"]["items"] == ["1"] and got[3, "one two three"]["n_hit"] == 2
    assert got[3, "another text"]["items"] == [""]
    assert got[4, LONG]["items"] == ["3"] and got[4, LONG]["n_hit"] == 20 and got[4, LONG]["n_words_"] == 30_000
    assert got[1, None]["n_words_"] == 0 and out.count() == 10
    assert decontaminate.decontaminate(none, items).collect() == []
    assert all(r["n_hit"] == 0 for r in decontaminate.decontaminate(odd, items.limit(0)).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta gamma"), (2, "alpha " + "x " * 30 + "beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    got = {r["doc_id"]: (r["items"], r["near_items"]) for r in decontaminate.decontaminate(docs, items, near=True).collect()}
    assert got == {1: ([], ["9"]), 2: ([], [])}


def test_substring_dedup(spark, odd, none):
    out = rlz.dedupe_substrings(odd)
    assert out.columns == [*odd.columns, "n_words_", "n_removed"]
    got = out.collect()
    assert {r["doc_id"]: r["n_removed"] for r in got if r["n_removed"]} == {5: 30_000} and len(got) == 10
    words = [f"w{i}" for i in range(25)]
    twice = spark.createDataFrame([(1, " ".join(words + ["mid"] + words))], "doc_id long, text string")
    row = rlz.dedupe_substrings(twice).first()
    assert row["text"] == " ".join(words + ["mid"]) and row["n_removed"] == 25
    assert rlz.dedupe_substrings(none).collect() == []


def test_mixing(spark, odd, none):
    got = mixing.plan(odd).collect()
    assert len(got) == 10 and all(len(r["draws"]) <= 2 for r in got)
    assert [r["source_size"] for r in got if r["source"] is None] == [0]
    assert mixing.plan(none).collect() == [] and mixing.mix(none).collect() == []
    mixed = mixing.mix(odd)
    assert mixed.columns == [*odd.columns, "pass", "shard", "place"]
    assert mixed.count() == sum(len(r["draws"]) for r in got)


def test_split_tree():
    tree = mixing.split_tree([1000, 10, 0, 777], 8)
    assert tree.sum(axis=0).tolist() == [1000, 10, 0, 777] and (tree >= 0).all()
    assert max(tree.sum(axis=1)) - min(tree.sum(axis=1)) <= 3
    assert (tree == mixing.split_tree([1000, 10, 0, 777], 8)).all()


def test_language_id(spark, odd, none):
    model = langid.fit(odd, "lang", "text")
    out = langid.identify(odd, model)
    assert out.columns == [*odd.columns, "lang_pred", "score", "spans_"]
    got = out.collect()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 6)} == {"und"} and len(got) == 10
    assert {r["score"] for r in got if r["lang_pred"] == "und"} == {0.0}
    empty = langid.fit(none, "lang", "text")
    assert {r["lang_pred"] for r in langid.identify(odd, empty).collect()} == {"und"}
    assert langid.identify(none, model).collect() == []


def test_language_spans(spark):
    registry.ship(spark)
    rows = [("en", "the house and the garden " * 20), ("ru", "дом и сад стоят здесь " * 20)]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"), "lang", "text")
    (label, score, spans), = langid.identify_texts(["the garden и сад стоят здесь дом"], model)
    assert [s[2] for s in spans] == ["en", "ru"] and spans[0][:2] == (0, 10) and label == "ru" and 0.5 < score < 1


def test_simhash(spark, odd, none):
    got = simhash.link(odd).collect()
    assert len(got) == 10
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 6)} == {1} and {r["fp"] for r in got if r["doc_id"] == 1} == {0}
    kept = simhash.dedupe(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert ids == [(False, 1), (False, 3), (False, 3), (False, 4), (False, 7), (True, 0)]
    assert simhash.link(none).collect() == [] and simhash.dedupe(none).collect() == []


def test_simhash_tiles(spark):
    """Small tiles, a chain of links and random fingerprints give the classes of all pairs."""
    import random

    registry.ship(spark)
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(250):
        fps.append(rng.choice(fps) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted(set(fps))
    up = {x: x for x in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                up[top(a)] = top(b)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = simhash.classes(spark.createDataFrame([(x,) for x in signed], "fp long"), tile=4).collect()
    of = {r["node"] % (1 << 64): r["component"] for r in found}
    groups, want = {}, {}
    for x in fps:
        groups.setdefault(of.get(x, x if x not in of else None), set()).add(x)
        want.setdefault(top(x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
