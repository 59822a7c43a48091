"""Labels with little text beside large ones, candidates by script, and the best path against a plain one."""

import random

import numpy as np

from postwatch.llm import langid, registry


def test_rare_labels_are_learnt(spark):
    registry.ship(spark)
    rows = [("en", f"the house and the garden {i}") for i in range(20_000)] + [("ru", "дом и сад стоят здесь")] + [("el", f"το σπίτι και ο κήπος {i}") for i in range(3)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    for size in (20, 1000, 20_000):
        assert langid.fit(docs, "lang", "text", sample_docs=size).labels == ["el", "en", "ru"]


def test_even_share():
    assert langid.even_share([10**9, 5, 2000], 20_000) == 17_995
    assert langid.even_share([10**9] * 4, 20_000) == 5000
    assert langid.even_share([10**9] * 4000, 20_000) == langid.LABEL_DOCS


ENGLISH = "the a house river and of to people that with were their from which over under many some other".split()
FRENCH = "le la maison fleuve et du vers les gens que avec etaient leur depuis lequel dessus sous autre".split()


def learnt(rare: str, label: str = "xx", letters: int = 400_000):
    """A model of two large labels and a rare one."""
    rng = random.Random(1)
    texts = {
        "en": " ".join(rng.choice(ENGLISH) for _ in range(letters // 4)), "fr": " ".join(rng.choice(FRENCH) for _ in range(letters // 4)),
        label: rare,
    }
    labels = sorted(texts)
    grams, letters_ = np.zeros((langid.BUCKETS, 3)), np.zeros((len(langid.SCRIPT_NAMES), 3))
    for k, name in enumerate(labels):
        w = langid.cut([texts[name]])
        grams[:, k] = np.bincount(w.trigrams, minlength=langid.BUCKETS)
        letters_[:, k] = np.bincount(w.script, weights=w.end - w.start, minlength=len(langid.SCRIPT_NAMES))
    return langid.model_of(labels, grams, letters_)


def test_a_rare_label_takes_no_words_of_another_script():
    model = learnt("слова на языке редком", "ru")
    for text in ("Xylophonbauwerkstattgehilfe", "zxqvkjwpzxqv", "Przemysl Szczebrzeszyn wszystko chrzaszcz", "zxqvkjwpz the house"):
        label, _, spans = langid.identify_texts([text], model)[0]
        assert label != "ru" and all(s[2] != "ru" for s in spans), text
    # Words of its own script, known or not, are its own, and those of a script without labels are anyone's.
    assert langid.identify_texts(["совершенно новые", "щъыь"], model) == [("ru", 1.0, [(0, 16, "ru")]), ("ru", 1.0, [(0, 4, "ru")])]
    assert langid.identify_texts(["עברית"], model)[0][1] == 1.0
    mixed = langid.identify_texts(["the house of people совершенно новые"], model)[0]
    assert mixed[0] == "en" and mixed[2] == [(0, 19, "en"), (20, 36, "ru")]


def test_a_rare_label_of_the_same_script_takes_no_unknown_words():
    model = learnt("the house of that gr")
    for text in ("zxqvkjwpz", "Xylophonbauwerkstattgehilfe", "the people were under the house", "les gens que avec leur maison"):
        assert langid.identify_texts([text], model)[0][0] != "xx", text


def test_unseen_trigrams_cost_the_same_under_every_label():
    model = learnt("слова на языке редком", "ru")
    w = langid.cut(["qqqzzz"])
    unseen = model.logs[w.trigrams]
    assert np.allclose(unseen, unseen[:, :1])


def plain(scores, switch):
    """Labels of the best path, by trying all."""
    from itertools import product

    def value(path):
        return sum(s[k] for s, k in zip(scores, path)) - switch * sum(a != b for a, b in zip(path, path[1:]))

    return max(value(p) for p in product(range(scores.shape[1]), repeat=len(scores))), value


def test_best_path_against_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(40):
        sizes = rng.integers(1, 7, 3)
        scores = rng.normal(0, 6, (int(sizes.sum()), 3)).astype(np.float32)
        scores[rng.random(len(scores)) < 0.2, 1] = langid.NEVER
        got = langid.best_path(scores, np.repeat(np.arange(3), sizes), 3, 5.0)
        at = 0
        for n in sizes:
            best, value = plain(scores[at : at + n].astype(float), 5.0)
            assert abs(value(got[at : at + n]) - best) < 1e-3
            at += n


def test_ties_go_to_the_first_label():
    model = langid.model_of(["b", "c"], np.ones((langid.BUCKETS, 2)), np.ones((len(langid.SCRIPT_NAMES), 2)))
    assert langid.identify_texts(["word", "other words here"], model) == [("b", 1.0, [(0, 4, "b")]), ("b", 1.0, [(0, 16, "b")])]
    assert langid.identify_texts([None, "", "123 !"], model) == [("und", 0.0, [])] * 3
