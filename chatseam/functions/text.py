"""Text cleaning, tokens and character shares as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Two or more word characters; the ASCII-only \w would drop Cyrillic.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def clean_text(text: Column, collapse_newlines: bool = True) -> Column:
    """Unify line ends, squeeze spaces and tabs, limit blank lines to one, strip."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    # Lone spaces are already right, so only runs and tabs are rewritten.
    text = F.regexp_replace(text, r"[ \t]{2,}|\t", " ")
    if collapse_newlines:
        text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(text)


def tokens(text: Column, stop_words: Iterable[str] = ()) -> Column:
    """Lower-cased word tokens in text order, stop words removed."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
    stop_words = sorted(set(stop_words))
    if not stop_words:
        return found
    return F.filter(found, lambda token: ~token.isin(stop_words))


def with_bigrams(words: Column) -> Column:
    """The words followed by every pair of neighbours joined with a space."""

    def add_pairs(found: Column) -> Column:
        pairs = F.greatest(F.size(found) - 1, F.lit(0))
        return F.concat(
            found,
            F.zip_with(
                F.slice(found, 1, pairs),
                F.slice(found, 2, pairs),
                lambda left, right: F.concat(left, F.lit(" "), right),
            ),
        )

    # As a lambda variable the words are cut out of the text once, not per use.
    return F.transform(F.array(words), add_pairs)[0]


def chunks(text: Column, width: int = 512) -> Column:
    """The whole text cut into consecutive pieces of ``width`` code points."""
    last = F.floor((F.length(text) - 1) / width).cast("int")
    starts = F.sequence(F.lit(0), last)
    return F.when(
        F.length(text) > 0,
        F.transform(starts, lambda i: F.substring(text, i * width + 1, F.lit(width))),
    ).otherwise(F.array().cast("array<string>"))


def count_matching(text: Column, char_class: str) -> Column:
    """How many characters fall into a regular-expression class such as ``\\p{Lu}``."""
    return F.length(F.regexp_replace(text, f"[^{char_class}]", ""))


def md5_prefix(text: Column, length: int = 16) -> Column:
    return F.substring(F.md5(text), 1, length)
