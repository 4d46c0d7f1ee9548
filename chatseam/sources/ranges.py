"""Records of JSON documents of any size, cut out of byte ranges in parallel.

A document is read in pieces that end at a closing brace, many ranges at a time. Where a piece starts
(inside a string or not, at which depth) follows from all that comes before it, so every piece is first
summed up for both cases: quotes flip the one, brackets move the other. Sums over the pieces of a range, and
over the ranges of a document, give every piece its true start. A piece that closes a brace at the
depth of records ends a record; pieces between two such ends are brought together, so the largest
thing in one place is a record, never a document.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatseam.functions.json import as_record, document_items
from chatseam.functions.once import with_computed
from chatseam.sources.listing import FileEntry, escape_glob

# Workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Records of a document are numbered in stretches of 2**STRETCH groups.
STRETCH = 12
# Which list a piece ends in: "=" and its key (none for a root that is a list), or this.
NO_LIST = "-"

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[\[\]{:]', re.DOTALL)
_REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*(?:"|$)', re.DOTALL)
_PARTS = "struct<parts: array<struct<key: string, text: string, closed: boolean>>, after: string, opened: array<string>>"


def list_parts(value: str, inside: bool, depth: int, level: int) -> dict:
    """What of a piece lies in lists whose items have depth ``level``: texts, each with its list if it opens here."""
    parts, opened, after, key, last = [], [], None, None, None
    own, start = None, 0 if depth >= level else None
    for found in _TOKEN.finditer(value, _REST_OF_STRING.match(value).end() if inside else 0):
        token = found[0][0]
        if token == '"':
            last = found[0][1:-1]
        elif token == ":":
            key = last
        elif token == "]":
            depth -= 1
            if depth == level - 1:
                parts.append({"key": own, "text": value[start or 0 : found.start()], "closed": True})
                own, start, after = NO_LIST, None, NO_LIST
        else:
            if depth == level - 1:
                own, start = (f"={key if level == 2 else ''}" if token == "[" else NO_LIST), found.end()
                after = own
                opened += [own] if token == "[" else []
            depth += 1
    if start is not None:
        parts.append({"key": own, "text": value[start:], "closed": False})
    return {"parts": parts, "after": after, "opened": opened}


def _list_parts(*columns: Column) -> Column:
    """:func:`list_parts` of a column's pieces; null where the piece is null."""
    kind = pa.struct([
        ("parts", pa.list_(pa.struct([("key", pa.string()), ("text", pa.string()), ("closed", pa.bool_())]))),
        ("after", pa.string()), ("opened", pa.list_(pa.string())),
    ])

    @F.arrow_udf(_PARTS)
    def parts(value: pa.Array, inside: pa.Array, depth: pa.Array, level: pa.Array) -> pa.Array:
        found = [None] * len(value)
        places = pc.indices_nonzero(value.is_valid())
        rows = zip(*(column.take(places).to_pylist() for column in (value, inside, depth, level)), strict=True)
        for place, row in zip(places.to_pylist(), rows, strict=True):
            found[place] = list_parts(*row)
        return pa.array(found, kind)

    return parts(*columns)


def _count(text: Column, characters: str) -> Column:
    """How many of some ASCII characters a text holds."""
    rest = text
    for character in characters:
        rest = F.replace(rest, F.lit(character), F.lit(""))
    return F.octet_length(text) - F.octet_length(rest)


def _before(value: Column, *order: str, by: Sequence[str]) -> Column:
    """The sum of a column over the rows before."""
    rows = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(rows), F.lit(0))


def _last_before(value: Column, *order: str, by: Sequence[str]) -> Column:
    return F.last(value, ignorenulls=True).over(
        Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )


def _summed(pieces: DataFrame) -> DataFrame:
    """Add quotes and depth changes, and their sums before the piece within its range, for both starts of the range."""
    value = F.col("value")
    plain = F.when(value.contains("\\"), F.regexp_replace(value, r"(?s)\\.", "")).otherwise(value)
    quotes = _count(plain, '"')
    outside = F.when(quotes > 0, F.regexp_replace(plain, r'"[^"]*("|$)', "")).otherwise(plain)
    # What lies outside of strings for the one start lies inside of them for the other.
    rows = pieces.withColumns({"quotes": quotes % 2, "open0": _count(outside, "[{"), "close0": _count(outside, "]"), "open": _count(plain, "[{"), "close": _count(plain, "]")})
    rows = rows.withColumns({"open1": F.col("open") - F.col("open0"), "close1": F.col("close") - F.col("close0")})
    rows = rows.withColumn("local", _before(F.col("quotes"), "seen", by=["path", "range"]) % 2)

    def change(inside: Column) -> Column:
        brackets = F.when(inside == 0, F.col("open0") - F.col("close0")).otherwise(F.col("open1") - F.col("close1"))
        # The brace that ends the piece closes something unless it stands in a string.
        return brackets - F.when((inside + F.col("quotes")) % 2 == 0, 1).otherwise(0)

    rows = rows.withColumns({"change0": change(F.col("local")), "change1": change(1 - F.col("local"))})
    return rows.withColumns({f"depth{k}": _before(F.col(f"change{k}"), "seen", by=["path", "range"]) for k in (0, 1)})


def _started(pieces: DataFrame) -> DataFrame:
    """Pieces with their true start: ``inside`` a string (0 or 1) and ``depth``; ``root``, the document's first character; ``whole``, whether it closes; ``refused``, whether it is no list or object; ``first``, whether it is the document's first piece."""
    summed = _summed(pieces)
    ranges = summed.groupBy("path", "range").agg(
        F.sum("quotes").alias("quotes"), F.sum("change0").alias("change0"), F.sum("change1").alias("change1"),
        F.min_by(F.substring(F.btrim("value", F.lit("﻿ \t\r\n")), 1, 1), "seen").alias("head"),
        F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("size").alias("size"), F.min("seen").alias("first_seen"),
    )
    by = ["path"]
    document = Window.partitionBy("path")
    ranges = ranges.withColumn("inside", _before(F.col("quotes"), "range", by=by) % 2)
    ranges = ranges.withColumn("change", F.when(F.col("inside") == 0, F.col("change0")).otherwise(F.col("change1")))
    ranges = ranges.withColumns(
        {
            "depth": _before(F.col("change"), "range", by=by),
            "root": F.min_by("head", "range").over(document),
            "first_range": F.min("range").over(document),
            "last_depth": F.sum("change").over(document),
            # Every piece counts as if it ended with a brace; the last one may not, and then closes one too many.
            "extra": F.sum("bytes").over(document) - F.max("size").over(document),
        }
    )
    # The reader leaves out a byte-order mark, three bytes.
    extra = F.when(F.col("extra") < 0, F.col("extra") + 3).otherwise(F.col("extra"))
    ranges = ranges.withColumn("whole", (F.col("last_depth") == -extra) & extra.isin(0, 1))
    starts = ranges.select("path", "range", F.col("inside").alias("_inside"), F.col("depth").alias("_depth"), "root", "whole", "first_range", "first_seen")
    at_start = F.col("_inside") == 0
    return (
        summed.join(starts, ["path", "range"])
        .withColumns(
            {
                "inside": (F.col("local") + F.col("_inside")) % 2,
                "depth": F.col("_depth") + F.when(at_start, F.col("depth0")).otherwise(F.col("depth1")),
            }
        )
        .withColumn("after_depth", F.col("depth") + F.when(at_start, F.col("change0")).otherwise(F.col("change1")))
        .withColumn("level", F.when(F.col("root") == "[", 1).when(F.col("root") == "{", 2))
        .withColumn("refused", ~F.col("whole") | F.col("level").isNull())
        .withColumn("first", (F.col("range") == F.col("first_range")) & (F.col("seen") == F.col("first_seen")))
    )


def cut_records(pieces: DataFrame, envelope_keys: Sequence[str], bare_object: bool = True) -> DataFrame:
    """``path, ordinal, rec, reason`` of every item of every document.

    ``pieces``: ``path`` (which document), ``range`` (ascending within it), ``seen`` (ascending within the range), ``size``
    (bytes of the document), ``value`` (the text up to a closing brace or the end). A list is its items; an object is
    the first of ``envelope_keys`` that holds a list, otherwise itself. ``rec`` is null for an item that is no
    object, with the reason; documents that don't close, or are neither list nor object, are one such row.
    An item that is no valid JSON is left out alone, not with its document.
    """
    started = _started(pieces)
    inside = F.col("inside") == 1
    closing = F.when(inside, F.col("close1")).otherwise(F.col("close0"))
    special = (F.col("depth") < F.col("level")) | ((closing > 0) & (F.col("depth") - closing < F.col("level")))
    rows = started.withColumn("lists", _list_parts(F.when(special & F.col("whole"), F.col("value")), inside, F.col("depth"), F.col("level")))
    rows = rows.withColumns(
        {
            "ends": ((F.col("inside") + F.col("quotes")) % 2 == 0) & (F.col("after_depth") == F.col("level")),
            "parts": F.coalesce(
                F.col("lists.parts"),
                F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("value").alias("text"), F.lit(False).alias("closed"))),
            ),
        }
    )
    rows = rows.withColumn("breaks", F.size(F.filter("parts", lambda part: part["closed"])) + F.col("ends").cast("int"))
    local = ["path", "range"]
    rows = rows.withColumns({"group": _before(F.col("breaks"), "seen", by=local), "held": _last_before(F.col("lists.after"), "seen", by=local)})
    # A root that is a list comes first, then the envelope keys in their order.
    kinds = ["", *envelope_keys]
    ranges = rows.groupBy("path", "range").agg(
        F.sum("breaks").alias("breaks"), F.max_by("lists.after", F.when(F.col("lists.after").isNotNull(), F.col("seen"))).alias("after"),
        *[F.max(F.array_contains("lists.opened", f"={key}")).alias(f"opened_{k}") for k, key in enumerate(kinds)],
    )
    # One flag a kind: lists of what the ranges opened would be gathered anew for each range of a document.
    document = Window.partitionBy("path")
    chosen = F.coalesce(*[F.when(F.max(f"opened_{k}").over(document), F.lit(f"={key}")) for k, key in enumerate(kinds)])
    ranges = ranges.select(
        "path", "range", _before(F.col("breaks"), "range", by=["path"]).alias("_group"), _last_before(F.col("after"), "range", by=["path"]).alias("_held"), chosen.alias("chosen")
    )
    rows = rows.join(ranges, ["path", "range"]).withColumns(
        {"group": F.col("group") + F.col("_group"), "held": F.coalesce("held", "_held", F.lit(NO_LIST)), "itself": F.col("chosen").isNull() & (F.col("root") == "{")}
    )
    if not bare_object:
        rows = rows.where(~F.coalesce("itself", F.lit(False)))
    # A brace was left out at the end of each piece; the document's own end needs none, as records end before it.
    own_text = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("value").alias("text"), F.lit(False).alias("closed")))
    # A refused document goes on as its first piece.
    texts = rows.where("not refused or first").select(
        "path", "range", "seen", "held", "group", "itself", "chosen", "refused",
        F.posexplode(F.when(F.col("itself") | F.col("refused"), own_text).otherwise(F.col("parts"))).alias("part", "own"),
        F.col("parts").alias("_parts"),
    )
    closed_before = F.size(F.filter(F.slice("_parts", F.lit(1), F.col("part")), lambda part: part["closed"]))
    texts = texts.where(F.col("itself") | F.col("refused") | (F.coalesce("own.key", "held") == F.col("chosen"))).select(
        "path", "itself", "refused", "range", "seen", "part",
        F.when(F.col("itself"), F.lit(0)).otherwise(F.col("group") + closed_before).alias("group"),
        F.concat("own.text", F.when(F.col("own.closed"), F.lit("")).otherwise(F.lit("}"))).alias("text"),
    )
    grouped = (
        texts.groupBy("path", "group")
        .agg(F.first("itself").alias("itself"), F.first("refused").alias("refused"), F.array_sort(F.collect_list(F.struct("range", "seen", "part", "text"))).alias("texts"))
        .withColumn("text", F.make_valid_utf8(F.array_join(F.transform("texts", lambda piece: piece["text"]), "")))
    )
    item = F.regexp_replace(F.when(F.col("itself"), F.regexp_replace(F.ltrim(F.col("text")), "^﻿", "")).otherwise(F.col("text")), r"^\s*,", "")
    items = with_computed(
        grouped.select("path", "group", "refused", "itself", "text"),
        {"refused": F.col("refused"), "trimmed": F.btrim(item, F.lit(" \t\r\n"))},
        keep=lambda row: row["refused"] | (row["trimmed"] != ""),
    )
    # The last piece of an object that is its own record has a brace of its own or none left over.
    trimmed = F.col("trimmed")
    whole = F.coalesce(
        document_items(F.concat(F.lit("["), trimmed, F.lit("]")), ("records",), False),
        document_items(F.concat(F.lit("["), F.regexp_replace(trimmed, r"\s*\}$", ""), F.lit("]")), ("records",), False),
    )
    parsed = F.when(~F.col("refused"), F.coalesce(whole, F.array(F.lit(None).cast("variant"))))
    stretch = F.shiftright("group", STRETCH)
    # Both uses read the same columns of one shuffle, so items are parsed once.
    read = items.select("path", "group", parsed.alias("items")).repartition("path", stretch)
    sizes = read.groupBy("path", stretch.alias("stretch")).agg(F.sum(F.array_size("items")).alias("n"))
    sizes = sizes.select("path", "stretch", _before(F.col("n"), "stretch", by=["path"]).alias("earlier"))
    numbered = read.withColumn("stretch", stretch).join(sizes, ["path", "stretch"])
    numbered = numbered.withColumn("earlier", F.col("earlier") + _before(F.array_size("items"), "group", by=["path", "stretch"]))
    each = F.transform("items", lambda item: F.struct(as_record(item).alias("rec"), item.isNull().alias("bad")))
    none = F.array(F.struct(F.lit(None).cast("map<string,variant>").alias("rec"), F.lit(None).cast("boolean").alias("bad")))
    found = numbered.select("path", "earlier", F.posexplode(F.coalesce(each, none)).alias("at", "item"))
    ordinal, bad = (F.col("earlier") + F.col("at")).cast("bigint"), F.col("item.bad")
    return found.select(
        "path", F.when(bad.isNotNull(), ordinal).alias("ordinal"), "item.rec",
        F.when(bad.isNull(), F.lit("not a JSON list or object"))
        .when(F.col("item.rec").isNull(), F.concat(F.lit("item "), ordinal, F.when(bad, F.lit(" is not valid JSON")).otherwise(F.lit(" is not an object")))).alias("reason"),
    )


def read_ranges(spark: SparkSession, files: Sequence[FileEntry], columns: dict[str, Column], envelope_keys: Sequence[str], bare_object: bool = True) -> DataFrame:
    """:func:`cut_records` of files, with further ``columns`` of their metadata."""
    scan = spark.read.text([escape_glob(entry.path) for entry in files], lineSep="}").select(
        F.struct(F.col("_metadata.file_path").alias("file"), *[column.alias(name) for name, column in columns.items()]).alias("path"),
        F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("seen"),
        F.col("_metadata.file_size").alias("size"),
        "value",
    )
    return cut_records(scan, envelope_keys, bare_object).select(*[F.col("path")[name].alias(name) for name in columns], "ordinal", "rec", "reason")
