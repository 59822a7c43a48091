"""The language model learns from all of the training text."""

import functools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postwatch.llm import lmscore, registry
from postwatch.llm.common import keep


def test_all_windows_are_trained_on(spark, monkeypatch):
    registry.ship(spark)
    kept, n = {}, 8000
    monkeypatch.setattr(lmscore, "keep", lambda df, name: kept.setdefault(name, keep(df, name)))
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: F.pmod(F.col("id") * x, F.lit(97)).cast("string")), " ").alias("text")
    )
    lmscore.score(docs, F.lit(False))
    assert kept["windows"].count() == n
    assert kept["windows"].agg(F.sum(F.size("classes"))).first()[0] == n * 65


def test_large_logits():
    w = lmscore.first_weights(np.ones(lmscore.CLASSES))
    lmscore.parts(w)["b"][:3] = 200
    inputs, first, targets, valid = lmscore.blocks(np.array([20]))
    y = np.arange(20)
    g = lmscore.gradient(lmscore.parts(w), y[inputs], first, y[targets], valid)
    assert np.isfinite(g).all()





def test_the_model_does_not_depend_on_the_session(spark, monkeypatch):
    registry.ship(spark)
    monkeypatch.setattr(lmscore, "SHARD_WINDOWS", 40)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts, rows in ((8, "2000"), (64, "7"), (211, "100")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set(registry.BATCH_ROWS, rows)
            scored = lmscore.score(docs.repartition(parts % 5 + 1), F.pmod(F.col("doc_id"), F.lit(10)) == 0)
            found.append({r["doc_id"]: r["score"] for r in scored.collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set(registry.BATCH_ROWS, registry.TEXT_ROWS)
    for other in found[1:]:
        assert max(abs(other[d] - x) for d, x in found[0].items()) < 1e-6 * max(map(abs, found[0].values()))


def test_steps_do_not_depend_on_how_rows_come():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 65, 300)
    y = rng.integers(0, lmscore.CLASSES, int(sizes.sum())).astype(np.int32)
    ends = np.append(0, np.cumsum(sizes))
    out = []
    for step in (300, 7, 64):
        t = lmscore.Training(lmscore.first_weights(np.ones(lmscore.CLASSES)), 3, 0.01)
        for a in range(0, 300, step):
            b = min(300, a + step)
            t.feed(sizes[a:b], y[ends[a] : ends[b]])
        out.append(t.result())
    assert out[0] == out[1] == out[2] and out[0][1] == int(sizes.sum())


TEXTS = ["", None, " ".join(f"unheardof{i} strengthlessness the zq{i}" for i in range(50)), "one two", " ".join(["a"] * 64), "x" * 300]


@functools.cache
def known_leads() -> lmscore.Leads:
    return lmscore.Leads(open(lmscore.VOCABULARY, "rb").read())


def ids_of(texts: list) -> list[list[int]]:
    """All subwords of each text, the end behind them."""
    leads = known_leads()
    return [[i for w in (t or "").split() for i in leads.encoder.encode_ordinary(f" {w}")] + [len(leads.leading)] for t in texts]


def no_frequent() -> lmscore.Frequent:
    none = np.zeros(0, np.int64)
    return lmscore.Frequent(open(lmscore.VOCABULARY, "rb").read(), pa.array([], pa.string()), none.astype(float), none, none)


def test_every_subword_is_a_target_once_with_what_is_before_it():
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(TEXTS))]), pa.array(TEXTS, pa.string())], ["id", "text"])
    ids = ids_of(TEXTS)
    # Ids for classes, as far as sixteen bits hold them.
    of = np.arange(len(lmscore.Leads(no_frequent().vocabulary).leading) + 1) % 30_000
    (out,) = lmscore.training_windows([batch], no_frequent(), of)
    windows, before = out.column("classes").to_pylist(), out.column("before").to_pylist()
    targets = [x for w, b in zip(windows, before) for x in w[b:]]
    assert targets == [int(of[i]) for text in ids for i in text]
    assert len(windows) == 1 + 1 + 4 + 1 + 1 + 1
    at, sent = 0, [int(of[i]) for text in ids for i in text]
    for w, b in zip(windows, before):
        assert w[:b] == sent[at - b : at] and b in (0, lmscore.BEFORE)
        at += len(w) - b
    assert before == [0, 0, 0, *[lmscore.BEFORE] * 3, 0, 0, 0]


def test_a_window_is_trained_as_it_is_scored(monkeypatch):
    """The blocks of a cut text see the same inputs, and have the same targets, as those of the whole one."""
    rng, seen = np.random.default_rng(1), []
    monkeypatch.setattr(lmscore, "gradient", lambda p, x, first, y, valid: (seen.append((x, first, y, valid)), np.zeros(lmscore.N_WEIGHTS, np.float32))[1])
    y = rng.integers(0, lmscore.CLASSES, 160)
    t = lmscore.Training(lmscore.first_weights(np.ones(lmscore.CLASSES)), 3, 0.01)
    t.feed(np.array([80, 80 + lmscore.BEFORE]), np.concatenate([y[:80], y[80 - lmscore.BEFORE :]]), np.array([0, lmscore.BEFORE]))
    assert t.result()[1] == 160
    t = lmscore.Training(lmscore.first_weights(np.ones(lmscore.CLASSES)), 3, 0.01)
    t.feed(np.array([160]), y)
    t.result()

    def shown(x, first, y, valid):
        return [(np.where(f, -1, a[:16]).tolist() + a[16:].tolist(), b[v].tolist()) for a, f, b, v in zip(x, first, y, valid) if v.any()]

    assert shown(*seen[0]) == shown(*seen[1]) and len(shown(*seen[0])) == 10


def test_every_subword_is_scored():
    """With weights of zero all classes are alike, and a word's rest goes by the shares of all its subwords."""
    vocabulary = no_frequent().vocabulary
    end = ids_of([""])[0][0]
    n, leading = np.random.default_rng(2).integers(0, 50, end + 1).astype(float), np.append(lmscore.leading_subwords(vocabulary), True)
    found = lmscore.classed(n, leading, n, n / 2)
    # Classes are of first subwords or of others, and their shares sum to one.
    assert (found.leading[found.of] == leading).all()
    assert np.allclose(np.bincount(found.of, weights=np.exp(found.log), minlength=lmscore.CLASSES), 1)
    scorer = lmscore.Scorer(found, np.zeros(lmscore.N_WEIGHTS, np.float32))
    tokens, _, _, score, waiting = scorer.texts(pa.array(TEXTS, pa.string()), no_frequent())
    each, led = -np.log(lmscore.CLASSES), np.log(found.leading.mean())
    for text, ids, got, others in zip(TEXTS, ids_of(TEXTS), score.to_pylist(), waiting.to_pylist()):
        own = [ids_of([w])[0][:-1] for w in (text or "").split()]
        assert sum(map(len, own)) + 1 == len(ids)
        assert got * np.log(10) == pytest.approx(sum(found.log[i] + each - led for i in [*(w[0] for w in own), end]), rel=1e-5)
        rests = {}
        for w, pieces in zip((text or "").split(), own):
            rests.setdefault(w, []).append(sum(found.log[i] + each for i in pieces[1:]) + led)
        assert {x["word"]: pytest.approx(x["rests"], rel=1e-5) for x in others} == rests
        assert all(x["tf"] == len(x["rests"]) and x["unit"] == found.unit[ids_of([x["word"]])[0][0]] for x in others)
    assert tokens.to_pylist() == [len((t or "").split()) + 1 for t in TEXTS]


def test_counted_words_are_scored_alike_in_both_ways():
    """Words that the tasks know, and words that are joined, get the same probability."""
    text, vocabulary = TEXTS[2], no_frequent().vocabulary
    n = np.ones(ids_of([""])[0][0] + 1)
    scorer = lmscore.Scorer(lmscore.classed(n, np.append(lmscore.leading_subwords(vocabulary), True), n, n), lmscore.first_weights(np.ones(lmscore.CLASSES)))
    kinds = pa.array(sorted(set(text.split())), pa.string())
    sizes, subwords = lmscore.Leads(vocabulary).pieces(kinds)
    seen = lmscore.Frequent(vocabulary, kinds, np.full(len(kinds), 3.0), sizes, subwords)
    whole = scorer.texts(pa.array([text]), seen)[3][0].as_py()
    _, _, _, score, waiting = scorer.texts(pa.array([text]), no_frequent())
    more = sum(
        np.log10(lmscore.COUNTED * 3.1 / np.exp(x["unit"]) + (1 - lmscore.COUNTED) * np.exp(rest)) for x in waiting[0].as_py() for rest in x["rests"]
    )
    assert whole == pytest.approx(score[0].as_py() + more)
