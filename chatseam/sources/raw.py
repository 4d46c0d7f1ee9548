"""Readers that bring every raw format into one shape.

A raw record is ``source_file`` (base name), ``record_file`` (path below the
scanned directory), ``format_rank``, ``ordinal`` (0-based position in the file)
and ``rec``, a map from field name to VARIANT. Because the shape never depends
on the data, files with different fields union without any alignment, and
``(format_rank, record_file, ordinal)`` orders all records of a corpus.

Unreadable input never fails a job: it is kept out of the records and listed,
with the reason, by the ``*_rejects`` readers.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatseam.functions.json import VARIANT_MAP, as_record, complete_json, document_items, object_items
from chatseam.functions.once import with_computed
from chatseam.functions.text import strip
from chatseam.session import prepare
from chatseam.sources.listing import FileEntry, directory_exists, escape_glob, list_files, qualified
from chatseam.sources.listing import read_first_record
from chatseam.sources.ranges import read_ranges
from chatseam.specs import DEFAULT_ENVELOPE_KEYS, CorpusSpec, raw_location

RAW_SCHEMA = (
    "source_file string, record_file string, format_rank int, ordinal bigint, rec map<string,variant>"
)
REJECT_SCHEMA = "source_file string, record_file string, reason string"

JSON_RANK, CSV_RANK, TEXT_RANK = 0, 1, 2

# CSV cells that mean "missing".
CSV_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# More splits than this and their positions are joined by a shuffle instead of a broadcast.
MAX_BROADCAST_SPLITS = 500_000


def empty_records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RAW_SCHEMA)


def empty_rejects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REJECT_SCHEMA)


def _reader(spark: SparkSession, suffix: str, recursive: bool):
    return (
        spark.read.option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", str(recursive).lower())
    )


def _scan_path(directory: str, suffix: str, recursive: bool) -> str:
    root = escape_glob(directory.rstrip("/"))
    return root if recursive else f"{root}/*{suffix}"


def _record_file(spark: SparkSession, directory: str) -> Column:
    """Path below the directory, so that equal base names in two folders stay apart."""
    root = qualified(spark, directory).rstrip("/") + "/"
    name, path = F.col("_metadata.file_name"), F.col("_metadata.file_path")
    # The URI may be written with one slash after the scheme or with three.
    below = F.substring_index(path, root.split(":", 1)[-1].lstrip("/"), -1)
    return F.when(below.contains("/") & ~below.startswith("/") & (below != path), below).otherwise(name)


# --- JSON documents ---------------------------------------------------------


# Documents of more bytes are read in ranges.
LARGE_DOCUMENT = 64 << 20


def _json_files(spark: SparkSession, directory: str, recursive: bool, large: int) -> tuple[list[FileEntry], list[FileEntry]]:
    """The files that are read whole and those that are read in ranges."""
    prepare(spark)
    files = list_files(spark, directory, ".json", recursive)
    return [entry for entry in files if entry.length <= large], [entry for entry in files if entry.length > large]


def _json_documents(
    spark: SparkSession, directory: str, recursive: bool, small: Sequence[FileEntry], any_large: bool
) -> DataFrame | None:
    if not small:
        return None
    paths = [escape_glob(entry.path) for entry in small] if any_large else _scan_path(directory, ".json", recursive)
    text = _reader(spark, ".json", recursive).text(paths, wholetext=True)
    return text.select(
        F.col("_metadata.file_name").alias("source_file"),
        _record_file(spark, directory).alias("record_file"),
        F.make_valid_utf8("value").alias("value"),
    )


def _range_items(
    spark: SparkSession, directory: str, files: Sequence[FileEntry], envelope_keys: Sequence[str], bare_object: bool
) -> DataFrame:
    columns = {"source_file": F.col("_metadata.file_name"), "record_file": _record_file(spark, directory)}
    return read_ranges(spark, files, columns, envelope_keys, bare_object)


def read_json(
    spark: SparkSession,
    directory: str,
    envelope_keys: Sequence[str] = DEFAULT_ENVELOPE_KEYS,
    recursive: bool = False,
    bare_object: bool = True,
    large: int = LARGE_DOCUMENT,
) -> DataFrame:
    """Records of all ``*.json`` documents; see :func:`document_items` for the envelope rule.

    A document of up to ``large`` bytes is one task's row until it is exploded; larger ones are cut
    into records range by range (:mod:`chatseam.sources.ranges`). Both give the same records, but for a
    large document with an invalid item, which loses that item only.
    """
    small, ranged = _json_files(spark, directory, recursive, large)
    documents = _json_documents(spark, directory, recursive, small, bool(ranged))
    records = empty_records(spark)
    if documents is not None:
        items = document_items(F.col("value"), envelope_keys, bare_object)
        # The parse sits inside the generator, where no filter can repeat it.
        parsed = documents.select(
            "source_file", "record_file", F.posexplode(F.transform(items, as_record)).alias("ordinal", "rec")
        )
        records = _json_records(parsed)
    if ranged:
        found = _json_records(_range_items(spark, directory, ranged, envelope_keys, bare_object))
        records = found if documents is None else records.unionByName(found)
    return records


def _json_records(items: DataFrame) -> DataFrame:
    return items.where("rec IS NOT NULL").select(
        "source_file",
        "record_file",
        F.lit(JSON_RANK).alias("format_rank"),
        F.col("ordinal").cast("bigint"),
        "rec",
    )


def json_rejects(
    spark: SparkSession,
    directory: str,
    envelope_keys: Sequence[str] = DEFAULT_ENVELOPE_KEYS,
    recursive: bool = False,
    large: int = LARGE_DOCUMENT,
) -> DataFrame:
    """Documents that are no JSON list or object, and list items that are no objects."""
    small, ranged = _json_files(spark, directory, recursive, large)
    documents = _json_documents(spark, directory, recursive, small, bool(ranged))
    rejects = empty_rejects(spark)
    if documents is not None:
        items = document_items(F.col("value"), envelope_keys, True)
        reasons = F.when(items.isNull(), F.array(F.lit("not a JSON list or object"))).otherwise(
            F.array_compact(
                F.transform(
                    items,
                    lambda item, pos: F.when(
                        as_record(item).isNull(), F.concat(F.lit("item "), pos, F.lit(" is not an object"))
                    ),
                )
            )
        )
        rejects = documents.select("source_file", "record_file", F.explode(reasons).alias("reason"))
    if ranged:
        items = _range_items(spark, directory, ranged, envelope_keys, True)
        found = items.where("rec IS NULL").select("source_file", "record_file", "reason")
        rejects = found if documents is None else rejects.unionByName(found)
    return rejects


# --- positions in splittable files -------------------------------------------


def _split_bound(spark: SparkSession, files: Sequence[FileEntry]) -> int:
    """An upper bound on the number of splits Spark cuts the files into."""
    most = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    least = _bytes(spark.conf.get("spark.sql.files.openCostInBytes"))
    total = sum(entry.length + least for entry in files)
    size = min(most, max(least, total // spark.sparkContext.defaultParallelism))
    return sum(entry.length // max(size, 1) + 1 for entry in files)


def _bytes(setting: str) -> int:
    digits = setting.rstrip("bBkKmMgG")
    unit = setting[len(digits):].lower()[:1]
    return int(digits) * {"": 1, "b": 1, "k": 2**10, "m": 2**20, "g": 2**30}[unit]


def _position() -> tuple[Column, ...]:
    return (
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seen"),
    )


def _number_rows(scan: DataFrame, split_bound: int) -> DataFrame:
    """Replace the position columns by ``ordinal``, the row's 0-based place in its file.

    Rows of a split come in file order and get consecutive ``_seen`` numbers, so
    one number and one count per split give every row its place. The rows
    themselves are not shuffled as long as the per-split table is small enough
    to broadcast.
    """
    splits = scan.groupBy("_path", "_block").agg(
        F.min("_seen").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    before = F.expr(
        "coalesce(sum(_rows) over (partition by _path order by _block"
        " rows between unbounded preceding and 1 preceding), 0)"
    )
    offsets = splits.select("_path", "_block", (before - F.col("_first")).alias("_shift"))
    if split_bound <= MAX_BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    return (
        scan.join(offsets, ["_path", "_block"])
        .withColumn("ordinal", F.col("_seen") + F.col("_shift"))
        .drop("_path", "_block", "_seen", "_shift")
    )


# --- text lines -------------------------------------------------------------


def read_text(
    spark: SparkSession, directory: str, suffix: str = ".txt", recursive: bool = False
) -> DataFrame:
    """One record per line: a JSON object is its fields, other JSON is dropped,
    and anything else becomes ``{body: line, msg_id: <file stem>_<line number>}``.

    The scan is line based, so a file of any size is split over many tasks.
    """
    prepare(spark)
    files = list_files(spark, directory, suffix, recursive)
    if not files:
        return empty_records(spark)
    scan = _reader(spark, suffix, recursive).text(_scan_path(directory, suffix, recursive))
    scan = scan.select(
        F.col("_metadata.file_name").alias("source_file"),
        _record_file(spark, directory).alias("record_file"),
        strip(F.make_valid_utf8("value")).alias("line"),
        *_position(),
    )
    lines = _number_rows(scan, _split_bound(spark, files)).where("line <> ''")
    line = F.col("line")
    # The first character tells most lines apart: objects are parsed once, and
    # chat text that cannot be JSON is not parsed at all.
    parsed = with_computed(lines, {"items": F.when(line.startswith("{"), object_items(line))})
    stem = F.regexp_replace("source_file", r"(?<=.)\.[^.]*$", "")
    plain = F.create_map(
        F.lit("body"),
        line.cast("variant"),
        F.lit("msg_id"),
        F.concat(stem, F.lit("_"), (F.col("ordinal") + 1).cast("string")).cast("variant"),
    ).cast(VARIANT_MAP)
    other_json = line.rlike(r'^[\["\-0-9tfnNI]') & (
        complete_json(line).isNotNull() | line.isin("NaN", "Infinity", "-Infinity")
    )
    record = F.when(F.size("items") == 1, F.col("items")[0]).when(~other_json, plain)
    return with_computed(parsed, {"rec": record}, keep=lambda row: row["rec"].isNotNull()).select(
        "source_file", "record_file", F.lit(TEXT_RANK).alias("format_rank"), "ordinal", "rec"
    )


# --- CSV --------------------------------------------------------------------


def _csv_row(text: str) -> list[str] | None:
    """The first CSV row of the text if its quotes are closed."""
    if text.count('"') % 2:
        return None
    lines = text.removeprefix("\ufeff").splitlines(True)
    return next(csv.reader(lines), [])


# A header row may go on over this many lines; beyond them its quotes count as not closed.
HEADER_LINES = 50


def _header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The names of a file's header row; none if there is no row or its quotes don't close."""
    text = read_first_record(spark, path, lambda read: bool(_csv_row(read)), HEADER_LINES)
    names: list[str] = []
    for position, name in enumerate((_csv_row(text) if text else None) or []):
        name = name or f"Unnamed: {position}"
        copies = sum(1 for other in names if other == name or other.rsplit(".", 1)[0] == name)
        names.append(f"{name}.{copies}" if name in names else name)
    return tuple(names)


def read_csv(
    spark: SparkSession, directory: str, recursive: bool = False, multiline: bool = True
) -> DataFrame:
    """Records of all ``*.csv`` files with a header; every cell stays text.

    Headers differ between files, so each distinct header is one scan. With
    ``multiline`` a quoted cell may hold line breaks and a file is one task;
    without it files are split. Rows with more or fewer cells than the header are
    no records; ``csv_rejects`` lists them.
    """
    prepare(spark)
    files = list_files(spark, directory, ".csv", recursive)
    if not files:
        return empty_records(spark)
    scans = [
        _csv_scan(spark, directory, header, members, multiline)
        for header, members in _by_header(spark, files).items()
        if header
    ]
    records = empty_records(spark) if not scans else scans[0]
    for scan in scans[1:]:
        records = records.unionByName(scan)
    return records


def _by_header(spark: SparkSession, files: Sequence[FileEntry]) -> dict[tuple[str, ...], list[FileEntry]]:
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda entry: _header(spark, entry.path), files))
    groups: dict[tuple[str, ...], list[FileEntry]] = {}
    for entry, header in zip(files, headers):
        groups.setdefault(header, []).append(entry)
    return groups


def _csv_rows(
    spark: SparkSession,
    directory: str,
    header: tuple[str, ...],
    files: Sequence[FileEntry],
    multiline: bool,
) -> DataFrame:
    """All rows after the header, numbered; ``corrupt`` holds a row whose cells don't match the header."""
    columns = [f"c{i}" for i in range(len(header))]
    scan = spark.read.csv(
        [escape_glob(entry.path) for entry in files],
        schema=", ".join(f"{name} string" for name in [*columns, "corrupt"]),
        header=True,
        multiLine=multiline,
        quote='"',
        escape='"',
        mode="PERMISSIVE",
        columnNameOfCorruptRecord="corrupt",
    ).select(
        F.col("_metadata.file_name").alias("source_file"),
        _record_file(spark, directory).alias("record_file"),
        F.struct(*columns, "corrupt").alias("row"),
        *_position(),
    )
    # The parser tells whether a row is corrupt only if it also has to give its cells. Unpacking all of them
    # from one struct keeps the scan from being pruned to ``corrupt`` alone, whatever is asked of the rows.
    scan = scan.select("source_file", "record_file", "_path", "_block", "_seen", F.inline(F.array("row")))
    return _number_rows(scan, _split_bound(spark, files))


def _csv_scan(
    spark: SparkSession,
    directory: str,
    header: tuple[str, ...],
    files: Sequence[FileEntry],
    multiline: bool,
) -> DataFrame:
    columns = [f"c{i}" for i in range(len(header))]
    numbered = _csv_rows(spark, directory, header, files, multiline).where("corrupt is null")
    cells = F.map_from_arrays(
        F.array(*[F.lit(name) for name in header]), F.array(*[F.col(name).cast("variant") for name in columns])
    )
    present = F.filter(
        F.array(
            *[
                F.when(F.col(cell).isNotNull() & ~F.col(cell).isin(*CSV_MISSING), F.lit(name))
                for cell, name in zip(columns, header)
            ]
        ),
        lambda name: name.isNotNull(),
    )
    return numbered.select(
        "source_file",
        "record_file",
        F.lit(CSV_RANK).alias("format_rank"),
        "ordinal",
        F.map_filter(cells, lambda name, _: F.array_contains(present, name)).alias("rec"),
    )


def csv_rejects(
    spark: SparkSession, directory: str, recursive: bool = False, multiline: bool = True
) -> DataFrame:
    """CSV files without a header row whose quotes close, and rows whose cells don't match the header."""
    groups = _by_header(spark, list_files(spark, directory, ".csv", recursive))
    without = [(entry.path.rsplit("/", 1)[-1],) * 2 + ("no header row",) for entry in groups.get((), [])]
    rejects = spark.createDataFrame(without, REJECT_SCHEMA)
    for header, members in groups.items():
        if header:
            rows = _csv_rows(spark, directory, header, members, multiline).where("corrupt is not null")
            first = F.concat(F.lit(" ("), F.coalesce("c0", F.lit("")), F.lit(")"))
            reason = F.concat(F.lit("row "), F.col("ordinal"), first, F.lit(f" does not have {len(header)} cells"))
            rejects = rejects.unionByName(rows.select("source_file", "record_file", reason.alias("reason")))
    return rejects


# --- a whole corpus ------------------------------------------------------------


def read_corpus_raw(spark: SparkSession, spec: CorpusSpec, root: str | None = None) -> DataFrame:
    """All raw records of a corpus: JSON and CSV if its formats name them, then text.

    A missing or empty directory gives an empty frame.
    """
    if spec.load is not None:
        return spec.load(spark, spec)
    directory = raw_location(spec, root)
    if not directory_exists(spark, directory):
        return empty_records(spark)
    parts = []
    if "json" in spec.formats:
        parts.append(read_json(spark, directory, spec.envelope_keys, spec.recursive))
    if "csv" in spec.formats:
        parts.append(read_csv(spark, directory, spec.recursive))
    if spec.scan_text:
        parts.append(read_text(spark, directory, recursive=spec.recursive))
    records = empty_records(spark) if not parts else parts[0]
    for part in parts[1:]:
        records = records.unionByName(part)
    return records


def corpus_rejects(spark: SparkSession, spec: CorpusSpec, root: str | None = None) -> DataFrame:
    """What :func:`read_corpus_raw` had to leave out, as ``(source_file, record_file, reason)``."""
    directory = raw_location(spec, root)
    rejects = empty_rejects(spark)
    if spec.load is not None or not directory_exists(spark, directory):
        return rejects
    if "json" in spec.formats:
        rejects = rejects.unionByName(json_rejects(spark, directory, spec.envelope_keys, spec.recursive))
    if "csv" in spec.formats:
        rejects = rejects.unionByName(csv_rejects(spark, directory, spec.recursive))
    return rejects


def read_exploration_raw(spark: SparkSession, directory: str) -> DataFrame:
    """The exploratory scan: recursive, JSON if there is any and CSV otherwise.

    Here only ``messages`` is an envelope, and an object without it has no records.
    """
    if list_files(spark, directory, ".json", recursive=True):
        return read_json(spark, directory, ("messages",), recursive=True, bare_object=False)
    if list_files(spark, directory, ".csv", recursive=True):
        return read_csv(spark, directory, recursive=True)
    raise FileNotFoundError(f"no .json or .csv files below {directory}")
