"""JSON text to VARIANT, accepting complete documents only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

VARIANT_ARRAY = "array<variant>"
VARIANT_MAP = "map<string,variant>"


def _in_object(text: Column) -> Column:
    return F.concat(F.lit('{"v":'), text, F.lit("}"))


def _in_array(text: Column) -> Column:
    return F.concat(F.lit("["), text, F.lit("]"))


def complete_json(text: Column) -> Column:
    """The text as a VARIANT, or null unless all of it is one JSON value.

    Spark's parser stops after the first value, so ``12 hello`` would pass as
    12. Inside brackets the rest of the text has to close properly. A text with
    a bracket of its own could close them early and is tried in braces too.
    """
    items = F.try_variant_get(F.try_parse_json(_in_array(text)), "$", VARIANT_ARRAY)
    closes_early = text.contains("]") & F.try_parse_json(_in_object(text)).isNull()
    return F.when((F.size(items) == 1) & ~closes_early, items[0])


def object_items(text: Column) -> Column:
    """For text that starts with a brace: ``[record]`` if it is one JSON object, else null or another length."""
    items = F.try_variant_get(F.try_parse_json(_in_array(text)), "$", f"array<{VARIANT_MAP}>")
    closes_early = text.rlike(r"\}\s*\]") & F.try_parse_json(_in_object(text)).isNull()
    return F.when(~closes_early, items)


def as_record(value: Column) -> Column:
    """A JSON object as a map from field name to VARIANT; null for any other kind."""
    return value.try_cast(VARIANT_MAP)


def document_items(text: Column, envelope_keys: Sequence[str], bare_object: bool) -> Column:
    """The array of items a whole JSON document stands for; null if it stands for none.

    A list is its own items. An object stands for the first envelope field that
    holds a list, otherwise (if ``bare_object``) for itself. Lists are read item
    by item, so only a single item, not the document, has to fit a VARIANT.
    """
    text = F.btrim(text, F.lit("\ufeff \t\r\n"))
    as_list = F.from_json(_in_object(text), f"struct<v {VARIANT_ARRAY}>")["v"]
    # Only "]" followed by "}" can close the wrapping early; then brackets are tried too.
    closes_early = text.rlike(r"\]\s*\}") & F.from_json(_in_array(text), f"array<{VARIANT_ARRAY}>").isNull()
    fields = ", ".join(f"`{key}` {VARIANT_ARRAY}" for key in envelope_keys)
    envelope = F.from_json(text, f"struct<{fields}>")
    as_envelope = F.coalesce(*[envelope[key] for key in envelope_keys])
    whole_object = complete_json(text)
    own = F.when(as_record(whole_object).isNotNull(), F.array(whole_object)) if bare_object else (
        F.when(as_record(whole_object).isNotNull(), F.array().cast(VARIANT_ARRAY))
    )
    return F.when(text.startswith("["), F.when(~closes_early, as_list)).when(
        text.startswith("{"), F.coalesce(as_envelope, own)
    )
