"""Order MinHash fingerprints, in DataFrame functions alone.

A word, a run without white space, of at most ``PIECE`` code points is a piece.  A longer run has a piece of ``PIECE``
code points from each of its code points on, so that an insertion changes the pieces around it alone.  ``K`` pieces in a row are
a k-mer.  The j-th occurrence of a k-mer counts as one of its own.  The occurrence-numbered k-mers are
hashed and dealt into ``BINS`` bins; of each bin the ``TUPLE`` smallest are selected, put in the order of
the text, and hashed as a tuple.  Tuples agree where the k-mers and their order agree, so the share of
equal tuples falls with the edit distance, moved passages included.

All steps are array functions on the text's own row, most of them on sorted longs; there is no shuffle.  An
element is 32 bits of hash and 31 bits of position.

Defined results: a null text counts as the empty one; a text with fewer pieces than ``K`` has one k-mer,
all its pieces, and the empty text has the k-mer of no pieces; equal texts have equal fingerprints, and so
do texts that differ in white space alone; a bin that is empty in both texts does not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.llm.common import fresh

PIECE = 12
K = 3
BIN_BITS = 6
TUPLE = 2
POSITION = (1 << 31) - 1
_INK = r"[^\x20\x09-\x0D]"
#: Captures a short word, which is then passed over, or else looks ahead from a code point (not from half of one).
_PIECES = (
    rf"(?![\x{{DC00}}-\x{{DFFF}}])(?=((?<!{_INK}){_INK}{{1,{PIECE}}}+(?!{_INK})|{_INK}{{{PIECE}}}))"
    rf"(?:(?<!{_INK}){_INK}{{1,{PIECE}}}+(?!{_INK}))?"
)


def bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once; a plain column would be worked out at each use."""
    return F.transform(F.array(value), body)[0]


def _hash_of(x: Column) -> Column:
    return F.shiftright(x, 31)


def _element(h: Column, position: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(h, 32), 31).bitwiseOR(position.cast("long"))


def _bin(x: Column, bits: int) -> Column:
    return F.shiftright(x, 63 - bits)


def signature(text: Column, k: int = K, bin_bits: int = BIN_BITS, size: int = TUPLE) -> Column:
    """Array of longs, one for each bin with k-mers: the bin's number and 32 bits of its tuple's hash."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PIECES), F.lit(1))

    def kmers(p: Column) -> Column:
        n = F.size(p)
        many = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(p, i + j) for j in range(k)]))
        return F.when(n >= k, many).otherwise(F.array(F.xxhash64(p)))

    def placed(h: Column) -> Column:
        return F.sort_array(F.transform(h, _element))

    def numbered(s: Column) -> Column:
        """Equal k-mers stand together in the order of the text; each gets its number among them."""
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: F.coalesce(_hash_of(F.get(s, i - 1)) != _hash_of(F.get(s, i)), F.lit(True)),
        )

        def runs(at: Column) -> Column:
            return F.flatten(F.transform(at, lambda a, n: F.transform(
                F.slice(s, a + 1, F.coalesce(F.get(at, n + 1), F.size(s)) - a),
                lambda x, j: _element(F.xxhash64(_hash_of(x), j), x.bitwiseAND(F.lit(POSITION))),
            )))

        return F.sort_array(bound(starts, runs))

    def smallest(t: Column) -> Column:
        return F.filter(t, lambda x, i: F.coalesce(_bin(F.get(t, i - size), bin_bits) != _bin(x, bin_bits), F.lit(True)))

    def tuples(kept: Column) -> Column:
        firsts = F.filter(
            F.sequence(F.lit(0), F.size(kept) - 1),
            lambda i: F.coalesce(_bin(F.get(kept, i - 1), bin_bits) != _bin(F.get(kept, i), bin_bits), F.lit(True)),
        )

        def one(i: Column) -> Column:
            number = _bin(F.get(kept, i), bin_bits)
            own = F.filter(F.slice(kept, i + 1, size), lambda x: _bin(x, bin_bits) == number)
            # Position first, so that sorting brings back the order of the text.
            in_order = F.sort_array(F.transform(
                own, lambda x: F.shiftleft(x.bitwiseAND(F.lit(POSITION)), 32).bitwiseOR(_hash_of(x))
            ))
            low = F.transform(in_order, lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)))
            return F.shiftleft(number, 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64(low), 32))

        return F.transform(firsts, one)

    hashed = F.transform(pieces, lambda x: F.xxhash64(x))
    return bound(bound(bound(bound(bound(hashed, kmers), placed), numbered), smallest), tuples)


def likeness(a: Column, b: Column) -> Column:
    """Share of bins, of those with k-mers in either text, whose tuples are equal."""
    def bins(x: Column) -> Column:
        return F.transform(x, lambda y: F.shiftright(y, 32))

    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(bins(a), bins(b)))


def fingerprint(sig: Column) -> Column:
    """A signature as text."""
    return F.lower(F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 10, "0")), ""))


def with_signature(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Add ``signature``, with an underscore where the name is taken."""
    return docs.withColumn(fresh(docs, "signature")[0], signature(F.col(text_col), **options))
