"""Fragments of the checking SQL (DuckDB dialect)."""

from __future__ import annotations

from collections.abc import Iterable

from chatseam.functions.languages import FUNCTION_WORDS
from chatseam.functions.text import WHITESPACE


def words(values: Iterable[str]) -> str:
    return ", ".join("'" + value.replace("'", "''") + "'" for value in values)


def strip(text: str) -> str:
    return f"trim({text}, '{WHITESPACE}')"


def clean(text: str, collapse: bool = True) -> str:
    text = rf"regexp_replace({text}, '\r\n?', chr(10), 'g')"
    text = rf"regexp_replace({text}, '[ \t]+', ' ', 'g')"
    if collapse:
        text = rf"regexp_replace({text}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(text)


def tokens(text: str, stop_words: Iterable[str] = ()) -> str:
    found = rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}')"
    stop_words = list(stop_words)
    return f"list_filter({found}, lambda w: w NOT IN ({words(stop_words)}))" if stop_words else found


def bigrams(tokens_column: str) -> str:
    t = tokens_column
    return f"[{t}[i] || ' ' || {t}[i + 1] for i in range(1, len({t}))]"


def language(text: str) -> str:
    hits = ", ".join(
        f"len(list_filter(found, lambda w: w IN ({words(profile)}))) AS {code}" for code, profile in FUNCTION_WORDS.items()
    )
    codes = list(FUNCTION_WORDS)
    best = " ".join(
        f"WHEN {code} > 0 " + "".join(f"AND {code} >= {other} " for other in codes[i + 1 :]) + f"THEN '{code}'"
        for i, code in enumerate(codes)
    )
    cyrillic = rf"length(regexp_replace({text}, '[^\x{{0400}}-\x{{04FF}}]', '', 'g'))"
    letters = rf"length(regexp_replace({text}, '[^\p{{L}}]', '', 'g'))"
    return (
        f"CASE WHEN {text} IS NULL THEN 'unknown' WHEN {cyrillic} > 0 AND {cyrillic} * 2 >= {letters}"
        f" THEN CASE WHEN regexp_matches({text}, '[іїєґІЇЄҐ]') THEN 'uk' ELSE 'ru' END"
        f" ELSE (SELECT CASE {best} ELSE 'unknown' END FROM (SELECT {hits} FROM"
        rf" (SELECT regexp_extract_all(lower({text}), '\p{{L}}+') AS found))) END"
    )
