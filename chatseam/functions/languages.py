"""Language labelling by script share and function words.

A substitute for a statistical detector, not an equal of one: it knows the
languages it has words for and answers ``unknown`` for everything else.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatseam.functions.text import count_matching

UNKNOWN = "unknown"

# Common function words per language. Order breaks ties.
FUNCTION_WORDS: dict[str, tuple[str, ...]] = {
    "en": (
        "the", "and", "of", "to", "in", "is", "it", "that", "for", "with", "as", "was", "on",
        "are", "by", "this", "be", "at", "from", "or", "have", "not", "you", "what", "which",
    ),
    "fr": (
        "le", "la", "les", "des", "et", "un", "une", "est", "que", "qui", "dans", "pour", "pas",
        "sur", "du", "au", "aux", "par", "avec", "il", "elle", "ne", "ce", "vous", "nous",
    ),
    "de": (
        "der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "von", "zu", "den",
        "im", "für", "auf", "sich", "auch", "als", "dem", "wie", "wir", "sie", "ich", "bei", "oder",
    ),
    "es": (
        "el", "los", "las", "del", "y", "en", "una", "es", "por", "para", "con", "no", "se",
        "su", "al", "lo", "como", "más", "pero", "sus", "este", "ha", "está", "son", "muy",
    ),
}

_CYRILLIC = r"\u0400-\u04FF"
_UKRAINIAN_ONLY = r"[іїєґІЇЄҐ]"
_WORD_PATTERN = r"\p{L}+"


def detect_language(
    text: Column, profiles: Mapping[str, Sequence[str]] = FUNCTION_WORDS
) -> Column:
    """Language code of the whole text.

    Mostly Cyrillic letters give ``ru`` (``uk`` if Ukrainian letters occur).
    Otherwise the language whose function words occur most often wins, earlier
    profiles first on a tie, and no hit at all gives ``unknown``. The words are
    constants in the plan (a hash-set test), so no join and no shuffle happens.
    """
    vocabulary = sorted({word for words in profiles.values() for word in words})
    found = F.filter(
        F.regexp_extract_all(F.lower(text), F.lit(_WORD_PATTERN), F.lit(0)),
        lambda word: word.isin(vocabulary),
    )

    def best_profile(hits: Column) -> Column:
        return F.array_max(
            F.array(
                *[
                    F.struct(
                        F.size(F.filter(hits, _is_one_of(words))).alias("hits"),
                        F.lit(-rank).alias("rank"),
                        F.lit(code).alias("code"),
                    )
                    for rank, (code, words) in enumerate(profiles.items())
                ]
            )
        )

    # Going through a one-element array binds the hits to a lambda variable, so
    # that they are found once and not once per language.
    scored = F.transform(F.array(found), best_profile)[0]
    by_words = F.transform(
        F.array(scored), lambda best: F.when(best["hits"] > 0, best["code"]).otherwise(F.lit(UNKNOWN))
    )[0]
    cyrillic_letters = count_matching(text, _CYRILLIC)
    mostly_cyrillic = cyrillic_letters * 2 >= count_matching(text, r"\p{L}")
    return (
        F.when(text.isNull(), F.lit(UNKNOWN))
        # The cheap test keeps the two counting passes away from other scripts.
        .when(
            text.rlike(f"[{_CYRILLIC}]") & mostly_cyrillic,
            F.when(text.rlike(_UKRAINIAN_ONLY), F.lit("uk")).otherwise(F.lit("ru")),
        )
        .otherwise(by_words)
    )


def _is_one_of(words: Sequence[str]):
    return lambda word: word.isin(list(words))


def needs_detection(language: Column) -> Column:
    return language.isNull() | (language == UNKNOWN)
