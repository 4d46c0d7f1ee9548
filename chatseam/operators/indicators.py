"""Indicators and named tools in message texts."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatseam.functions.checksums import is_bitcoin, is_mixed_case

# Workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

# Spelled out because what \b takes for a word differs between Java versions.
WORD_START = r"(?<![\p{L}\p{N}_])"
WORD_END = r"(?![\p{L}\p{N}_])"

PATTERNS: dict[str, str] = {
    "btc": rf"{WORD_START}(?:bc1[a-z0-9]{{25,59}}|[13][1-9A-HJ-NP-Za-km-z]{{25,34}}){WORD_END}",
    "cve": rf"(?i:{WORD_START}CVE-[0-9]{{4}}-[0-9]{{4,7}}{WORD_END})",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "eth": rf"{WORD_START}0x[0-9a-fA-F]{{40}}{WORD_END}",
    "ipv4": rf"{WORD_START}(?:{_OCTET}\.){{3}}{_OCTET}{WORD_END}",
    "url": r"https?://[^\s<>\"']+",
}

# Text a match must contain; a substring test is far cheaper than the pattern.
_MUST_CONTAIN = {"email": "@", "eth": "0x", "url": "://", "ipv4": "."}

# A starting point for the tool list; callers pass their own.
TOOL_NAMES = (
    "cobalt strike", "metasploit", "mimikatz", "psexec", "rclone", "bloodhound", "anydesk",
    "trickbot", "emotet", "bazarloader", "qakbot", "icedid",
)


def word_list_pattern(names: Sequence[str]) -> str:
    """A case-insensitive pattern for whole names, longer ones first."""
    ordered = sorted(names, key=lambda name: (-len(name), name))
    return rf"(?iu:{WORD_START}(?:{'|'.join(re.escape(name) for name in ordered)}){WORD_END})"


def _found(text: Column, kind: str, pattern: str) -> Column:
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if kind in _MUST_CONTAIN:
        values = F.when(text.contains(_MUST_CONTAIN[kind]), values).otherwise(F.array().cast("array<string>"))
    return F.transform(
        values,
        lambda value, place: F.struct(
            F.lit(kind).alias("kind"), value.alias("value"), (place + 1).alias("start_no")
        ),
    )


def extract_indicators(
    messages: DataFrame,
    key: str = "message_id",
    text: str = "raw_text",
    patterns: Mapping[str, str] = PATTERNS,
    tools: Sequence[str] = (),
    checked: bool = False,
) -> DataFrame:
    """``(key, kind, value, start_no)``: every match in text order, numbered per kind.

    ``tools`` adds the kind ``tool``. One narrow pass, no shuffle. ``checked`` leaves out payment
    addresses (``btc``, ``eth``) whose checksum is wrong; numbers are those of all matches.
    """
    wanted = dict(patterns)
    if tools:
        wanted["tool"] = word_list_pattern(tools)
    found = F.flatten(F.array(*[_found(F.col(text), kind, pattern) for kind, pattern in wanted.items()]))
    rows = messages.select(key, F.inline(found))
    if not checked:
        return rows
    kind, value = F.col("kind"), F.col("value")
    wrong = ~F.coalesce(is_bitcoin(F.when(kind == "btc", value)), is_mixed_case(F.when(kind == "eth", value)), F.lit(True))
    return rows.where(~wrong)


def _places(names: Sequence[str]) -> Callable[[str], list[tuple[int, int, str]]]:
    """A function that finds names as whole words in a text: start, end and name, leftmost and longest, none overlapping."""
    import ahocorasick

    def lower(text: str) -> str:
        small = text.lower()
        # Places must be those of the text, so letters that grow stay as they are.
        return small if len(small) == len(text) else "".join(low if len(low := c.lower()) == 1 else c for c in text)

    automaton = ahocorasick.Automaton()
    for name in names:
        automaton.add_word(lower(name), name)
    automaton.make_automaton()

    def word(text: str, at: int) -> bool:
        return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")

    def find(text: str) -> list[tuple[int, int, str]]:
        found, out, free = [], [], 0
        for last, name in automaton.iter(lower(text)):
            start, end = last - len(name) + 1, last + 1
            if not word(text, start - 1) and not word(text, end):
                found.append((start, -end, name))
        for start, end, name in sorted(found):
            if start >= free:
                out.append((start, -end, name))
                free = -end
        return out

    return find


def match_names(
    messages: DataFrame, names: DataFrame, key: str = "message_id", text: str = "raw_text", most: int = 1_000_000
) -> DataFrame:
    """``(key, kind, name, value, start, end)``: every mention of a name of a gazetteer as whole words, case ignored.

    ``names`` has ``name`` and ``kind``; blank and null ones are left out, and a name of several kinds gives a row
    for each. Of mentions that overlap, the leftmost stays, of those the longest. ``start`` and ``end`` are code points
    from 0, ``value`` is what the text says. Names of any number are found in one pass over a text by an
    automaton that each task builds once; their number is counted first, and more than ``most`` are refused.
    """
    listed = names.select(F.btrim(F.lower("name")).alias("name"), F.col("kind").cast("string").alias("kind")).where("name <> ''").distinct()
    if (n := listed.count()) > most:
        raise ValueError(f"{n} names; a gazetteer of this size needs most={n} and workers that can hold it")
    kinds: dict[str, list[str]] = {}
    for row in listed.collect():
        kinds.setdefault(row["name"], []).append(row["kind"])
    key_kind = dict(messages.dtypes)[key]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _places(list(kinds))
        for batch in batches:
            owners, rows = [], []
            for owner, content in enumerate(batch.column(1).to_pylist()):
                for start, end, name in find(content) if content and kinds else ():
                    for kind in kinds[name]:
                        owners.append(owner)
                        rows.append((kind, name, content[start:end], start, end))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owners, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types)]],
                [key, "kind", "name", "value", "start", "end"],
            )

    schema = f"`{key}` {key_kind}, kind string, name string, value string, start long, end long"
    return messages.select(key, text).mapInArrow(match, schema)
