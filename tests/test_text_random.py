"""Text functions against plain Python on many random texts."""

import random
import re
import string

import pytest

from postwatch.functions import text as X
from postwatch.functions.contractions import CONTRACTIONS, expand_contractions
from postwatch.functions.words import TERMS
from postwatch.operators import posts as P

PIECES = [
    " ", "  ", "\n", "\t", "\xa0", " ", "\x1c", "@", "@you", "http", "http://t.co/a", "rt", "RT", "&amp;", '"',
    "#", "#Flu", "flu", "Zika,", "ebola.", "a", "ab", "the", "THE", "not", "é", "Straße", "ß", "—", "–", "...", "U.S.A.",
    "[x]", "{y}", "a|b", "c/d", "e:f", "why?", "no!", "'", "''", "y", "can't", "can't've", "she's", "y'all've",
    "you'll've", "xcan'tx", "I'M", "o'clock", "'cause", "sha'n't", "measles", "diarrhea", "0", "😀", "word", "-",
]


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(20240101)
    made = ["".join(rng.choice(PIECES) + rng.choice(["", "", " "]) for _ in range(rng.randrange(0, 14)))
            for _ in range(1500)]
    return made + [""] + PIECES


@pytest.fixture(scope="module")
def table(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "i INT, t STRING").cache()


def values(table, column):
    rows = table.select("i", column.alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def expanded(text, names):
    return re.sub("|".join(map(re.escape, names)), lambda m: CONTRACTIONS[m[0]], text)


def test_split_and_strip(table, lines):
    assert values(table, X.tokenize(table["t"])) == [t.split() for t in lines]
    assert values(table, X.strip(table["t"])) == [t.strip() for t in lines]


def test_contractions(table, lines):
    names = list(CONTRACTIONS)
    assert values(table, expand_contractions(table["t"])) == [expanded(t, names) for t in lines]
    names.sort(key=len, reverse=True)
    assert values(table, expand_contractions(table["t"], True)) == [expanded(t, names) for t in lines]


def test_clean(table, lines):
    def model(t):
        t = re.sub(r"@\S+", "", re.sub(r"http\S+", "", t.lower()).replace("#", ""))
        kept = [c for c in expanded(t, list(CONTRACTIONS)) if c not in string.punctuation]
        return "".join(kept).strip()

    assert values(table, X.clean_text(table["t"])) == [model(t) for t in lines]


def keyword_model(t, stops):
    out = []
    for token in t.split():
        if token[0] in "@&" or token.startswith("http") or token.startswith("rt"):
            continue
        if token[-1] == '"' or len(token) < 3:
            continue
        words = re.split(r'[,?/)(!\]\[{}#"—|.:–\s]+', token)
        out += [w.upper().lower() for w in words if w and w.upper() not in stops]
    return out


def test_keywords(table, lines, stop_words):
    stops = set(stop_words)
    want = [keyword_model(t, stops) for t in lines]
    assert values(table, X.keywords(table["t"], stop_words)) == want
    rows = P.explode_keywords(table, table["t"], stop_words).select("i", "keyword").collect()
    assert sorted(map(tuple, rows)) == sorted((i, w) for i, ws in enumerate(want) for w in ws)


def test_terms(table, lines):
    found = values(table, X.matched_terms(X.blank(table["t"], "#,."), TERMS))
    want = [[x for x in TERMS if x in [w.lower() for w in re.sub("[#,.]", " ", t).split()]] for t in lines]
    assert found == want
    inside = values(table, X.contains_any(table["t"], TERMS))
    assert inside == [any(x in t.lower() for x in TERMS) for t in lines]
