import pytest
from pyspark.sql import functions as F

from postwatch.functions import clock
from postwatch.functions import text as X
from postwatch.functions.contractions import CONTRACTIONS, expand_contractions
from postwatch.functions.words import TERMS

POST = ("RT @cdc: Flu season, #flu! I can't stop \"coughing\" http://t.co/x rtx U.S.A. Ebola-free")


def test_stop_words_are_complete(stop_words):
    assert len(stop_words) == 569
    assert stop_words[0] == "A'S" and stop_words[-1] == "ZERO" and "A" not in stop_words


def test_contractions_are_complete():
    assert len(CONTRACTIONS) == 118
    # The expansion looks for an apostrophe first.
    assert all("'" in c for c in CONTRACTIONS)


def test_keywords(one, stop_words):
    got = one(lambda c: X.keywords(c, stop_words), POST)
    assert got == ["flu", "season", "flu", "stop", "a", "ebola-free"]


def test_keyword_rules(one, stop_words):
    assert one(lambda c: X.keywords(c, stop_words), '&amp rtfm httpx @me quote" ab abc') == ["abc"]
    assert one(lambda c: X.keywords(c, stop_words), "Zika—virus|fever/ache") == [
        "zika", "virus", "fever", "ache"]


def test_terms(one):
    blanked = lambda c: X.matched_terms(X.blank(c, X.TERM_BLANKED), TERMS)
    assert one(blanked, POST) == ["flu"]
    assert one(blanked, "Zika,EBOLA.flu zika") == ["zika", "flu", "ebola"]
    assert one(blanked, "influence") == []


def test_contains_any(one):
    assert one(lambda c: X.contains_any(c, TERMS), POST) is True
    assert one(lambda c: X.contains_any(c, TERMS), "under the inFLUence") is True
    assert one(lambda c: X.contains_any(c, TERMS), "healthy") is False


def test_clean(one):
    assert one(X.clean_text, POST) == "rt  flu season flu i cannot stop coughing  rtx usa ebolafree"
    assert one(X.clean_text, "  Hi! ") == "hi"


@pytest.mark.parametrize(
    ("text", "in_order", "longest"),
    [
        ("i can't've she's y'alls", "i cannot've she is you alls", "i cannot have she is you alls"),
        ("you'll", "you you will", "you you will"),
        ("can't", "cannot", "cannot"),
        ("no apostrophe", "no apostrophe", "no apostrophe"),
        ("'", "'", "'"),
        ("", "", ""),
    ],
)
def test_contractions(one, text, in_order, longest):
    assert one(expand_contractions, text) == in_order
    assert one(lambda c: expand_contractions(c, longest_first=True), text) == longest


def test_expanded_text_is_not_expanded_again(one):
    # "y'all've" gives "you all have" in one pass, shadowed by "y'all" in table order.
    assert one(expand_contractions, "y'all've") == "you all've"


@pytest.mark.parametrize(
    "text",
    ["", "   ", "a b", " a\nb\t", "a\xa0b", "\xa0a　", "a\x1cb", "a\x85b", " a b "],
)
def test_white_space_is_that_of_python(one, text):
    assert one(X.tokenize, text) == text.split()
    assert one(X.strip, text) == text.strip()


def test_null_text(one, stop_words):
    for f in (X.tokenize, X.strip, X.clean_text, lambda c: X.keywords(c, stop_words)):
        assert one(f, None) is None


def test_tokenizer_words(one):
    assert one(X.tokenizer_words, "Don't stop--NOW\t(please)\n") == ["don't", "stop", "now", "please"]


def test_parse_created_at(one):
    shown = lambda c: F.date_format(clock.parse_created_at(c), "yyyy-MM-dd HH:mm:ss")
    assert one(shown, "Tue Oct 16 03:04:05 +0000 2018") == "2018-10-16 03:04:05"
    assert one(shown, "Tue Oct 16 03:04:05 -0400 2018") == "2018-10-16 07:04:05"
    assert one(shown, "no time") is None


def test_border(spark):
    got = spark.range(1).select(
        F.date_format(clock.border("2018-10-16 00:00:00 -0400"), "yyyy-MM-dd HH:mm:ss").alias("b")
    )
    assert got.first()["b"] == "2018-10-16 04:00:00"
