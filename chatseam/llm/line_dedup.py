"""Line deduplication across documents.

Every line of some length becomes a row of its key's 128-bit hash, document and position. The rows
are range-partitioned by hash and document and sorted by hash, document and position, so a task
streams over them and sees each key's first document first. A key may go on in the next partition (a very common line
fills many): such a partition's first run is settled by a second, tiny step. What is to
be dropped comes back as one compressed bitmap a document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatseam.llm.common import carried, restored, small_batches, stored, table
from chatseam.llm.registry import query

SPACE = b" \t\n\x0b\x0c\r"
LAST = 2**63 - 1


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def _document(frame: DataFrame) -> DataFrame:
    """Identify rows: by id (nulls last, as one document) and, as ids may repeat, by text."""
    return frame.withColumns(
        {"_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)), "_text_id": F.xxhash64("text")}
    )


def line_rows(documents: DataFrame, min_chars: int = 10) -> DataFrame:
    """``h1, h2, id, text_id, position`` of every line whose key has ``min_chars`` code points or more."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, owners, positions = [], [], []
            for owner, data in enumerate(batch.column(2).to_pylist()):
                for position, line in enumerate((data or b"").split(b"\n")):
                    key = line.strip(SPACE)
                    if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                        digests.append(xxhash.xxh3_128_digest(key.lower()))
                        owners.append(owner)
                        positions.append(position)
            hashes = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
            owner = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes[:, 0]),
                    pa.array(hashes[:, 1]),
                    batch.column(0).take(owner),
                    batch.column(1).take(owner),
                    pa.array(positions, pa.int32()),
                ],
                ["h1", "h2", "id", "text_id", "position"],
            )

    small_batches(documents.sparkSession)
    texts = _document(documents.select("doc_id", "text")).select("_id", "_text_id", F.col("text").cast("binary"))
    return texts.mapInArrow(rows, "h1 long, h2 long, id long, text_id long, position int")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream over sorted rows; kinds of what comes out:

    0: a smaller document holds the line. 1: the line is of the partition's first key and of the first
    document seen with it, so an earlier partition decides. 2: first document seen with the
    partition's first or last key; only hash and document count.
    """
    columns = ("h1", "h2", "id", "text_id", "position")
    key = head = None
    in_first = True
    heads = []
    for batch in batches:
        h1, h2, ids, text_ids, positions = (batch.column(c).to_numpy() for c in columns)
        if not len(ids):
            continue
        starts = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        starts[0] = key != (h1[0], h2[0])
        run = np.cumsum(starts) - 1
        firsts = ids[starts]
        first = np.where(run >= 0, firsts[np.maximum(run, 0)] if len(firsts) else 0, 0 if head is None else head)
        if key is None:
            heads.append((h1[0], h2[0], ids[0]))
        first_run = in_first & (run <= (0 if key is None else -1))
        in_first = in_first and bool(first_run[-1])
        kind = np.where(ids != first, 0, np.where(first_run, 1, -1)).astype(np.int32)
        kept = kind >= 0
        key, head = (h1[-1], h2[-1]), first[-1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[kept]) for x in (kind, h1, h2, ids, text_ids, positions)], ["kind", *columns]
        )
    if key is not None:
        heads.append((*key, head))
        a, b, c = (np.array(x, dtype=np.int64) for x in zip(*heads, strict=True))
        zero = np.zeros(len(a), dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (zero.astype(np.int32) + 2, a, b, c, zero, zero.astype(np.int32))], ["kind", *columns]
        )


def _bitmap(dropped: pd.Series) -> pd.Series:
    """Compressed bits, one a line up to the last dropped one: 1 for lines that stay."""
    def pack(positions) -> bytes:
        keep = np.ones(int(max(positions)) // 8 * 8 + 8, dtype=np.uint8)
        keep[positions] = 0
        return zlib.compress(np.packbits(keep).tobytes(), 1)

    return pd.Series([pack(x) for x in dropped])


def keep_bitmaps(documents: DataFrame, min_chars: int = 10) -> DataFrame:
    """``id, text_id, keep`` of the documents that lose lines; ``keep`` is a compressed bitmap."""
    order = ["h1", "h2", "id", "text_id", "position"]
    marks = stored(
        line_rows(documents, min_chars)
        .repartitionByRange("h1", "h2", "id")
        .sortWithinPartitions(*order)
        .mapInArrow(_stream, "kind int, h1 long, h2 long, id long, text_id long, position int")
    )
    # A few rows for each partition.
    firsts = marks.where("kind = 2").groupBy("h1", "h2").agg(F.min("id").alias("first"))
    unsettled = marks.where("kind = 1").join(firsts, ["h1", "h2"]).where("id > first")
    columns = ["id", "text_id", "position"]
    dropped = marks.where("kind = 0").select(columns).unionByName(unsettled.select(columns))
    return (
        dropped.groupBy("id", "text_id")
        .agg(F.collect_set("position").alias("dropped"))
        .select("id", "text_id", F.pandas_udf(_bitmap, "binary")("dropped").alias("keep"))
    )


def _keep_lines(text: pa.Array, keep: pa.Array) -> pa.Array:
    out, counts, drops = [], [], []
    for data, packed in zip(text.to_pylist(), keep.to_pylist(), strict=True):
        if packed is None:
            out.append(data)
            counts.append((data or b"").count(b"\n") + 1)
            drops.append(0)
            continue
        lines = data.split(b"\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), dtype=np.uint8))[: len(lines)]
        left = [line for line, bit in zip(lines, bits, strict=False) if bit] + lines[len(bits) :]
        out.append(b"\n".join(left))
        counts.append(len(lines))
        drops.append(len(lines) - len(left))
    return pa.StructArray.from_arrays(
        [pa.array(out, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(drops, pa.int64())],
        ["text", "n_lines", "n_dropped"],
    )


def dedup_lines(documents: DataFrame, n_lines: str | None = None, n_dropped: str | None = None, min_chars: int = 10) -> DataFrame:
    """Documents without the lines that a document of smaller id holds too.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased; only keys of
    ``min_chars`` code points or more count. All of a document's lines with a key stay if no smaller id has the key. All columns come back, ``text`` with what is left;
    ``n_lines`` and ``n_dropped`` name columns to add. Null text stays null and counts as one empty
    line. Documents with null id count as one document after all others, rows of equal id as one
    document; repeated rows lose the same lines. Empty texts and an empty table pass through.
    """
    bitmaps = keep_bitmaps(documents, min_chars).select(
        F.col("id").alias("_id"), F.col("text_id").alias("_text_id"), F.col("keep").alias("_keep")
    )
    joined = _document(carried(documents, "doc_id")).join(bitmaps, ["_id", "_text_id"], "left")
    kept = joined.withColumn("_kept", F.arrow_udf(_keep_lines, "struct<text: string, n_lines: bigint, n_dropped: bigint>")(F.col("text").cast("binary"), "_keep"))

    added = [F.col("_kept." + key).alias(name) for key, name in (("n_lines", n_lines), ("n_dropped", n_dropped)) if name]
    return kept.select(*restored(documents.columns, F.col("_kept.text")), *added)


@query(
    "op5_line_dedup",
    r"""
    WITH lines AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS position
      FROM documents),
    keyed AS (
      SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    heads AS (SELECT key, min(doc_id) AS head FROM keyed WHERE length(key) >= 10 GROUP BY key),
    judged AS (SELECT k.*, coalesce(k.doc_id > h.head, false) AS dropped FROM keyed k LEFT JOIN heads h USING (key))
    SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (NOT dropped), '')) AS kept_sha256
    FROM judged GROUP BY doc_id
    """,
)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "n_lines", "n_dropped")
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
