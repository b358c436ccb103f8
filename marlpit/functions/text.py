"""Text folding and matching as column expressions: no Python at run time."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@functools.cache
def _accents() -> tuple[str, str]:
    """Code points whose canonical decomposition is one character followed by marks only, and those characters."""
    src, dst = [], []
    for cp in range(0x80, 0x110000):
        c = chr(cp)
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and not unicodedata.category(d[0]).startswith("M") and all(unicodedata.category(x).startswith("M") for x in d[1:]):
            src.append(c)
            dst.append(d[0])
    return "".join(src), "".join(dst)


#: Letters that Hangul syllables are made of, in the order of the syllables' code points from U+AC00.
_LEAD, _VOWEL, _TAIL = ("".join(map(chr, r)) for r in (range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A8, 0x11C3)))


def _jamo(text: Column) -> Column:
    """Hangul syllables taken apart; other text as it is, and only looked at once."""

    def apart(c: Column) -> Column:
        n = F.ascii(c) - 0xAC00
        letter = lambda letters, k: F.substring(F.lit(letters), k.cast("int"), 1)
        tail = n % 28
        parts = F.concat(letter(_LEAD, n / 588 + 1), letter(_VOWEL, n % 588 / 28 + 1), F.when(tail > 0, letter(_TAIL, tail)).otherwise(F.lit("")))
        return F.when(n.between(0, 11171), parts).otherwise(c)

    return F.when(F.regexp_like(text, F.lit("[\\uAC00-\\uD7A3]")), F.array_join(F.transform(F.split(text, ""), apart), "")).otherwise(text)


def fold_text(text: Column) -> Column:
    """Accents off, lower case, everything but letters and digits to single spaces, trimmed; null folds to ''.

    Marks go before lower-casing.  Precomposed letters are mapped by ``translate``, Hangul syllables by their arithmetic.
    """
    bare = F.regexp_replace(F.translate(_jamo(text), *_accents()), r"\p{M}+", "")
    return F.coalesce(F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", " ")), F.lit(""))


@F.pandas_udf(T.StringType())
def _nfd(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFD", t))


def fold_text_exact(text: Column) -> Column:
    """:func:`fold_text` by full canonical decomposition (Arrow batches through Python)."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(F.regexp_replace(_nfd(text), r"\p{M}+", "")), r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def tokenize(folded: Column) -> Column:
    return F.filter(F.split(folded, " "), lambda t: t != "")


def is_subsequence(needle: Column, hay: Column) -> Column:
    """Whether the characters of ``needle`` occur in ``hay`` in order; an empty needle does."""
    at = F.aggregate(F.filter(F.split(needle, ""), lambda c: c != ""), F.lit(0), lambda p, c: _next_place(p, c, hay))
    return at >= 0


def _next_place(p: Column, c: Column, hay: Column) -> Column:
    place = F.call_function("locate", c, hay, p + 1)
    return F.when(p < 0, p).when(place > 0, place).otherwise(F.lit(-1))


def all_terms_match(folded: Column, terms: Column) -> Column:
    """Every term occurs in the folded text (a word prefix is a substring too)."""
    return F.forall(terms, lambda t: F.contains(folded, t))


def fnv31(text: Column) -> Column:
    """FNV-1a over UTF-16 code units, 31 bits."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def units(c: Column) -> Column:
        cp = F.ascii(c)
        high = F.lit(55296) + F.shiftright(cp - 65536, 10)
        low = F.lit(56320) + (cp - 65536).bitwiseAND(F.lit(1023))
        return F.when(cp < 65536, F.array(cp)).otherwise(F.array(high, low))

    h = F.aggregate(F.flatten(F.transform(chars, units)), F.lit(2166136261).cast("long"), lambda h, u: (h.bitwiseXOR(u.cast("long")) * 16777619).bitwiseAND(F.lit(4294967295)))
    return h.bitwiseAND(F.lit(2147483647))


def starts_capitalised(title: Column) -> Column:
    return F.upper(F.left(title, F.lit(1))) == F.left(title, F.lit(1))
