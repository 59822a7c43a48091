"""Text functions: white space, cleaning, keywords, terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postwatch.functions.contractions import expand_contractions

# White space as Python's str.split() and str.strip() see it.
SPACE = r"(?U)[\s\x1c-\x1f]"
NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"

# The ASCII punctuation removed by the cleaner.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Characters that a word counter's tokenizer takes for separators (no apostrophe).
TOKENIZER_SEPARATORS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n"

# Fixed values of the keyword rules.
KEYWORD_DROPPED_PREFIXES = ("@", "http", "rt", "&")
KEYWORD_DROPPED_SUFFIX = '"'
KEYWORD_BLANKED = ",?/)(!][{}#\"—|.:–"

# Blanked before terms are looked up.
TERM_BLANKED = "#,."


def tokenize(text: Column) -> Column:
    """Words between white space; no empty strings, an empty text gives an empty array."""
    return F.filter(F.split(text, SPACE + "+"), lambda t: t != "")


def strip(text: Column) -> Column:
    """Remove white space, Unicode included, at both ends."""
    # A run that is not at the end is tried once, not from each of its characters.
    return F.regexp_replace(text, f"^{SPACE}+|(?<!{SPACE}){SPACE}+$", "")


def blank(text: Column, characters: str) -> Column:
    """Replace each of the characters by a space."""
    return F.translate(text, characters, " " * len(characters))


def clean_text(text: Column, longest_first: bool = False) -> Column:
    """Lower case, no links, no hash signs, no mentions, no contractions, no punctuation."""
    out = F.lower(text)
    out = F.regexp_replace(out, f"http{NOT_SPACE}+", "")
    out = F.translate(out, "#", "")
    out = F.regexp_replace(out, f"@{NOT_SPACE}+", "")
    out = expand_contractions(out, longest_first)
    return strip(F.translate(out, PUNCTUATION, ""))


def is_keyword_token(token: Column) -> Column:
    """Whether a white-space token may hold keywords."""
    fits = (F.length(token) > 2) & ~F.endswith(token, F.lit(KEYWORD_DROPPED_SUFFIX))
    for start in KEYWORD_DROPPED_PREFIXES:
        fits = fits & ~F.startswith(token, F.lit(start))
    return fits


def keyword_parts(token: Column) -> Column:
    """Upper-case words of a token or of several with spaces between; some may be empty."""
    return F.split(F.upper(blank(token, KEYWORD_BLANKED)), " ")


def is_keyword(word: Column, stop_words: Sequence[str]) -> Column:
    """Whether an upper-case word is one.

    The stop words are a bounded list, so they travel with the plan as a hash set.
    """
    return (word != "") & ~word.isin(list(stop_words))


def keywords(text: Column, stop_words: Sequence[str]) -> Column:
    """Array of lower-case keywords, one entry per occurrence."""
    kept = F.array_join(F.filter(tokenize(text), is_keyword_token), " ")
    found = F.filter(keyword_parts(kept), lambda w: is_keyword(w, stop_words))
    return F.transform(found, F.lower)


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """Whether any of the terms occurs anywhere in the text, whatever its case."""
    lowered = F.lower(text)
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(lowered, F.lit(term))
    return found


def matched_terms(text: Column, terms: Sequence[str]) -> Column:
    """Terms that occur as whole words, each once, in the order of ``terms``."""
    wanted = F.array(*[F.lit(t) for t in terms])
    return F.array_intersect(wanted, F.transform(tokenize(text), F.lower))


def tokenizer_parts(text: Column) -> Column:
    """Lower-case pieces between separators and spaces; some are empty."""
    return F.split(blank(F.lower(text), TOKENIZER_SEPARATORS), " ")


def tokenizer_words(text: Column) -> Column:
    """Words of the bag-of-words tokenizer: lower case, split at separators and spaces."""
    return F.filter(tokenizer_parts(text), lambda w: w != "")
