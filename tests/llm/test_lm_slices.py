"""The language model works on slices that fit a core's cache, and cuts new words together."""

import numpy as np
import pyarrow as pa

from postwatch.llm import lmscore

TEXTS = [None, "", " \n\t ", "  Lead Ünï\x0b\x0cA\x00B\x1fC D E \u0085F ", "é中\U0001F600 42", "Word " * 50, "x" * 300]


def blocks(n: int):
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 66, n)
    y = rng.integers(0, lmscore.CLASSES, int(sizes.sum()))
    x = np.append(3, y[:-1])
    inputs, first, targets, valid = lmscore.blocks(sizes)
    return lmscore.parts(lmscore.first_weights(np.ones(lmscore.CLASSES))), x[inputs], first, y[targets], valid


def test_logits_are_made_in_small_parts(monkeypatch):
    made, real = [], lmscore.exponentials
    monkeypatch.setattr(lmscore, "exponentials", lambda z, *more: (made.append(z.size), real(z, *more))[1])
    p, x, first, y, valid = blocks(400)
    lmscore.gradient(p, x, first, y, valid)
    lmscore.log_probabilities(p, x, first, y)
    assert max(made) <= 100_000 < y.size * lmscore.CLASSES


def test_slices_do_not_change_results(monkeypatch):
    p, x, first, y, valid = blocks(100)
    g, logs = lmscore.gradient(p, x, first, y, valid), lmscore.log_probabilities(p, x, first, y)
    monkeypatch.setattr(lmscore, "BLOCKS", 3)
    monkeypatch.setattr(lmscore, "TARGETS", 7)
    assert np.allclose(lmscore.gradient(p, x, first, y, valid), g, atol=1e-6)
    assert np.allclose(lmscore.log_probabilities(p, x, first, y), logs, atol=1e-4)


def test_words_are_those_of_bytes():
    sizes, words = lmscore.split_words(pa.array(TEXTS, pa.string()))
    want = [(t or "").encode().lower().split() for t in TEXTS]
    assert sizes.tolist() == [len(w) for w in want]
    assert [w.encode() for w in words.to_pylist()] == sum(want, [])


def test_new_words_are_cut_together(monkeypatch):
    leads = lmscore.Leads(open(lmscore.VOCABULARY, "rb").read())
    words, calls, real = lmscore.split_words(pa.array(TEXTS, pa.string()))[1], [], leads.encoder

    class Counting:
        def encode_ordinary(self, text):
            calls.append(text)
            return real.encode_ordinary(text)

    leads.encoder = Counting()
    found = leads.of(words)
    assert len(calls) == 1
    assert found.tolist() == [real.encode_ordinary(f" {w}")[0] for w in words.to_pylist()] == leads.of(words).tolist()
