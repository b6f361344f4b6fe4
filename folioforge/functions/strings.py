"""String primitives with the semantics that captured text needs: Unicode white space, ASCII case folding, live LIKE wildcards."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: All characters that count as white space, and their class for Java's regular expressions, which has a faster test for
#: a plain class than for \\s with Unicode rules: one for all below 256 that stand alone, and one for each range or character above.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
WS = "[" + "".join(f"\\u{ord(c):04x}" for c in SPACES if c < "\u0100") + "\\u1680\\u2000-\\u200a\\u2028-\\u2029\\u202f\\u205f\\u3000]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text(c: Column) -> Column:
    """Null as empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Stripped, with runs of white space as one space."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "), F.lit(" "))


def nonempty(c: Column) -> Column:
    """The stripped text, or null if nothing is left."""
    return F.nullif(strip(text(c)), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only, as database NOCASE order has it."""
    return F.translate(c, UPPER, LOWER)


def like_any_case(c: Column, fragment: str) -> Column:
    """Whether c holds the fragment, ASCII case aside; % and _ in the fragment are wildcards and \\ is an ordinary character."""
    pattern = "%" + fragment.translate(str.maketrans(UPPER, LOWER)) + "%"
    escape = next(x for x in "\x01\x02\x03" if x not in pattern)
    return F.like(ascii_lower(c), F.lit(pattern), F.lit(escape))


def dedupe(items: Column, key=F.lower) -> Column:
    """The items stripped, without blanks and without later ones of the same key, in order."""
    clean = F.filter(F.transform(items, lambda x: strip(text(x))), lambda x: x != "")
    first = lambda c, keys: F.filter(c, lambda x, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1)
    # Arrays of one bind the items and their keys; without them each item would compute all anew.
    return F.transform(F.array(clean), lambda c: F.transform(F.array(F.transform(c, key)), lambda keys: first(c, keys))[0])[0]


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def _unaccented(s: pd.Series) -> pd.Series:
    fold = lambda x: "".join(c for c in unicodedata.normalize("NFD", x.lower()) if not unicodedata.combining(c))
    return s.map(lambda x: x if x is None else x.lower() if x.isascii() else fold(x))


def _beyond_ascii(c: Column, change, plain: Column) -> Column:
    """change(c) for texts with characters beyond ASCII, which alone go to Python; `plain` for the others."""
    return F.coalesce(F.pandas_udf(change, StringType())(F.when(F.octet_length(c) > F.char_length(c), c)), plain)


def nfkc(c: Column) -> Column:
    return _beyond_ascii(c, _nfkc, c)


def unaccented(c: Column) -> Column:
    """Case folded and without combining marks, for index tokens."""
    return _beyond_ascii(c, _unaccented, F.lower(c))


def safe_int(c: Column) -> Column:
    """A whole number from text, null where it is none."""
    return strip(text(c)).try_cast("int")
