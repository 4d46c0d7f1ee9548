"""SentencePiece encoding and decoding over a relational lattice.

Texts are gathered in chunks. A chunk keeps each word once, and words are cut where no piece of the
table can cross; the stretches between cuts, each once per chunk, travel by hash. There their
bounded-length substrings are exploded, an equi-join with the piece table leaves the edges of the
lattice, and a fold over a stretch's edges keeps the best path to every place (Viterbi). Pieces go
back to the chunks, whose documents are lists of references to words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatseam.llm.common import small_batches, stored_in_buckets, table
from chatseam.llm.registry import query

MARK = "▁"
LONGEST_STRETCH = 64
CHUNK = 1 << 24
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Pieces:
    """``rows``: piece (with a space for the mark), id, score in millionths. ``first_byte``: the id of byte 0; the others follow."""

    rows: tuple[tuple[str, int, int], ...]
    first_byte: int
    size: int

    @property
    def longest(self) -> int:
        return max(len(piece) for piece, _, _ in self.rows)

    @property
    def unknown(self) -> int:
        """The score of a character that has no piece and is spelt in bytes."""
        return min(score for _, _, score in self.rows) - 10_000_000

    def texts(self) -> list[bytes]:
        """What each id stands for."""
        out = [b""] * self.size
        for piece, number, _ in self.rows:
            out[number] = piece.encode()
        for byte in range(256):
            out[self.first_byte + byte] = bytes([byte])
        return out


class Cutter:
    """Cuts words where no piece can cross.

    A piece over the place between b and c in a word with a, b, c, d is ``bc`` itself or holds ``abc`` or ``bcd``.
    Both questions go to tables of hashes: a collision leaves a place uncut, which changes no result.
    """

    BITS = 22

    def __init__(self, pieces: Pieces):
        grams = [{p for p, _, _ in pieces.rows if len(p) == 2}, {p[k : k + 3] for p, _, _ in pieces.rows for k in range(len(p) - 2)}]
        self.pairs, self.triples = (np.zeros(1 << self.BITS, dtype=bool) for _ in grams)
        for known, found in zip((self.pairs, self.triples), grams, strict=True):
            if found:
                known[self.hashes(*np.array([[ord(c) for c in gram] for gram in sorted(found)], np.uint32).T)] = True

    def hashes(self, *characters: np.ndarray) -> np.ndarray:
        out = np.zeros(len(characters[0]), dtype=np.uint32)
        for c in characters:
            out = (out ^ c) * np.uint32(0x9E3779B1)
            out ^= out >> np.uint32(15)
        return out & np.uint32((1 << self.BITS) - 1)

    def cuts(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where stretches begin in the characters of all words, one after the other; ``first``: where words do."""
        starts = np.zeros(len(codes) + 1, dtype=bool)
        starts[first] = starts[-1] = True
        crossed = np.zeros(len(codes), dtype=bool)
        if len(codes) > 1:
            crossed[1:] = self.pairs[self.hashes(codes[:-1], codes[1:])]
        if len(codes) > 2:
            held = self.triples[self.hashes(codes[:-2], codes[1:-1], codes[2:])] & ~starts[1:-2] & ~starts[2:-1]
            crossed[1:-1] |= held
            crossed[2:] |= held
        return np.flatnonzero(starts[:-1] | ~crossed)

    def stretches(self, words: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
        """The stretches of all words one after the other, and how many each word has. No word is empty or null."""
        if not len(words):
            return words, np.empty(0, np.int64)
        whole = "".join(words.to_pylist())
        codes = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        first = np.cumsum(np.r_[0, pc.utf8_length(words).to_numpy()])[:-1]
        cuts = self.cuts(codes, first)
        # Bytes before each character: the code point says how many it takes.
        before = np.r_[0, np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), dtype=np.int64)]
        offsets = before[np.r_[cuts, len(codes)]]
        inner = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(offsets), pa.py_buffer(whole.encode()))
        return inner, np.diff(np.r_[np.searchsorted(cuts, first), len(cuts)])

    def cut(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The same for a list of words."""
        inner, per_word = self.stretches(pa.array(words, pa.large_string()))
        return inner.to_pylist(), per_word


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield tag >> 3, data[at : at + size]
        at += size


def read_pieces(path: str = MODEL) -> Pieces:
    """Read a model file. Its order of merges is taken as a ranking by frequency: scores are log chances by Zipf's law.

    Scores are whole millionths, so that sums are exact and ties are ties. Pieces with marks inside (runs of spaces) are
    left out: every space starts a word.
    """
    with open(path, "rb") as file:
        entries = [dict(_fields(value)) for field, value in _fields(file.read()) if field == 1]
    normal = [(e[1].decode(), k) for k, e in enumerate(entries) if e.get(3, 1) == 1]
    first_byte = next(k for k, e in enumerate(entries) if e.get(3, 1) == 6)
    total = math.log(sum(1 / (r + 1) for r in range(len(normal))))
    rows = [
        (p.replace(MARK, " "), k, round(-1e6 * (math.log(rank + 1) + total)))
        for rank, (p, k) in enumerate(normal)
        if p and MARK not in p[1:] and " " not in p
    ]
    return Pieces(tuple(rows), first_byte, len(entries))


def encode_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    """``bucket, unit, ids`` of distinct ``bucket, unit``, without a shuffle if ``units`` is partitioned by bucket.

    The piece table is a model's vocabulary, some ten thousand rows. A unit of n characters has at most
    n times the longest piece substrings. Of equal paths the one whose last piece starts first wins.
    """
    spark = units.sparkSession
    vocabulary = F.broadcast(spark.createDataFrame(list(pieces.rows), "piece string, id int, score long"))
    starts = units.select("bucket", "unit", F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("at"))
    room = F.least(F.lit(pieces.longest), F.length("unit") - F.col("at") + 1)
    spans = starts.select("bucket", "unit", "at", F.explode(F.sequence(F.lit(1), room)).alias("size"))
    edges = spans.withColumn("part", F.substring(F.col("unit"), F.col("at"), F.col("size"))).join(vocabulary, F.col("part") == F.col("piece"), "left")
    edges = edges.where(F.col("id").isNotNull() | (F.col("size") == 1))
    edge = F.struct(
        (F.col("at") + F.col("size") - 1).alias("end"),
        (F.col("at") - 1).alias("start"),
        F.coalesce("score", F.lit(pieces.unknown)).alias("score"),
        F.coalesce("id", F.lit(-1)).alias("id"),
    )
    lattice = edges.groupBy("bucket", "unit").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    step = "struct<score: long, start: int, id: int>"
    origin = F.array(F.struct(F.lit(0).alias("score"), F.lit(0).alias("start"), F.lit(-1).alias("id"))).cast(f"array<{step}>")

    def reach(best, e):
        score = F.get(best, e["start"])["score"] + e["score"]
        new = F.array(F.struct(score.alias("score"), e["start"].alias("start"), e["id"].alias("id")))
        return (
            F.when(e["end"] == F.size(best), F.concat(best, new))
            .when(score > F.get(best, e["end"])["score"], F.concat(F.slice(best, F.lit(1), F.size(best) - 1), new))
            .otherwise(best)
        )

    def spelt(start):
        raw = F.encode(F.substring(F.col("unit"), start + 1, F.lit(1)), "UTF-8")
        return F.transform(
            F.sequence(F.lit(1), F.octet_length(raw)),
            lambda k: F.conv(F.hex(F.substring(raw, k, F.lit(1))), 16, 10).cast("int") + pieces.first_byte,
        )

    def back(state, _):
        last = F.get(F.col("best"), state["at"])
        own = F.when(last["id"] >= 0, F.array(last["id"])).otherwise(spelt(last["start"]))
        return F.when(state["at"] > 0, F.struct(last["start"].alias("at"), F.concat(own, state["ids"]).alias("ids"))).otherwise(state)

    end = F.struct((F.size("best") - 1).alias("at"), F.array().cast("array<int>").alias("ids"))
    return (
        lattice.select("bucket", "unit", F.aggregate("edges", origin, reach).alias("best"))
        .select("bucket", "unit", F.aggregate(F.sequence(F.lit(1), F.size("best")), end, back)["ids"].alias("ids"))
    )


def fold_long(stretch: str, pieces: dict[str, tuple[int, int]], longest: int, unknown: int, first_byte: int) -> list[int]:
    """The same fold for one stretch of any length, in time and memory proportional to it."""
    best, back = [0], [(0, -1)]
    for end in range(1, len(stretch) + 1):
        top = None
        for start in range(max(0, end - longest), end):
            piece = pieces.get(stretch[start:end])
            if piece is None:
                if end - start > 1:
                    continue
                piece = (-1, unknown)
            score = best[start] + piece[1]
            if top is None or score > top[0]:
                top = (score, start, piece[0])
        best.append(top[0])
        back.append(top[1:])
    ids, end = [], len(stretch)
    while end:
        start, number = back[end]
        ids.append([number] if number >= 0 else [first_byte + byte for byte in stretch[start:end].encode()])
        end = start
    return [i for part in reversed(ids) for i in part]


def press(numbers: np.ndarray) -> bytes:
    """Non-negative numbers under 2**32, byte plane by byte plane: small numbers leave the higher planes empty."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpress(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each of many runs, one run after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def encode(documents: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_pieces, ids, round_trip`` of every row.

    ``round_trip``: decoding ``ids`` gives the text back, byte for byte. Null and empty texts have no pieces.
    A text gets one space in front, as the table's pieces expect. Characters without a piece are spelt in bytes.
    Words of any length are encoded whole: the lattice takes stretches of up to LONGEST_STRETCH characters, a longer
    one (or one with a zero character) is folded where its chunk is made. Repeated rows and null ids each come back, other columns don't.
    An empty table gives an empty result.

    ``chunk``: characters a chunk gathers; a longer text is a chunk by itself. It changes no result.
    """
    spark = documents.sparkSession
    small_batches(spark)
    pieces = read_pieces(model)
    texts_of, kind = pieces.texts(), dict(documents.dtypes)["doc_id"]
    partitions = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 8 * partitions

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, by_text = Cutter(pieces), {p: (k, score) for p, k, score in pieces.rows}
        longest, unknown = pieces.longest, pieces.unknown
        made = TaskContext.get().partitionId() << 32

        def flush():
            """The words by falling use, so that references are small; the stretches by bucket, those too long for the lattice last."""
            nonlocal made
            # A word has the space before it, unless it starts a line: then it has the line end.
            lines = pc.replace_substring(pa.array([text or None for text in texts], pa.large_string()), "\n", " \n")
            texts.clear()
            found = pc.split_pattern(lines, " ")
            del lines
            per_doc = press(pc.fill_null(pc.list_value_length(found), 0).to_numpy())
            coded = found.flatten().dictionary_encode()
            del found
            every = coded.indices.to_numpy()
            order = np.argsort(-np.bincount(every, minlength=len(coded.dictionary)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            refs = press(rank[every])
            words = coded.dictionary.take(pa.array(order))
            del coded, every
            empty, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
            words = pc.if_else(pc.starts_with(words, "\n"), words, pc.binary_join_element_wise(empty, words, space))
            inner, per_word = cutter.stretches(words)
            inner = inner.dictionary_encode()
            alone = pc.or_(pc.greater(pc.utf8_length(inner.dictionary), LONGEST_STRETCH), pc.match_substring(inner.dictionary, "\0")).to_pylist()
            of = np.array([buckets if a else zlib.crc32(x.encode()) % buckets for a, x in zip(alone, inner.dictionary.to_pylist(), strict=True)], np.int64)
            by = pc.sort_indices(pa.table([of, inner.dictionary], ["bucket", "unit"]), [("bucket", "ascending"), ("unit", "ascending")]).to_numpy()
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            distinct = inner.dictionary.take(pa.array(by)).to_pylist()
            starts = np.searchsorted(of[by], np.arange(buckets + 1)).tolist()
            own = [fold_long(x, by_text, longest, unknown, pieces.first_byte) for x in distinct[starts[-1] :]]
            row = {
                "chunk": made,
                "doc_ids": ids,
                "digests": digests,
                "refs": refs,
                "per_doc": per_doc,
                "inner": press(place[inner.indices.to_numpy()]),
                "per_word": press(per_word),
                "own": press(np.array([i for x in own for i in x], np.int64)),
                "per_own": press(np.array([len(x) for x in own], np.int64)),
                "dealt": [{"bucket": k, "units": "\0".join(distinct[a:b])} for k, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)) if a < b],
            }
            made += 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        ids, digests, texts, size, schema = [], [], [], 0, None
        for batch in batches:
            schema = schema or pa.schema(
                [("chunk", pa.int64()), ("doc_ids", pa.list_(batch.schema.field(0).type)), ("digests", pa.list_(pa.binary()))]
                + [(name, pa.binary()) for name in ("refs", "per_doc", "inner", "per_word", "own", "per_own")]
                + [("dealt", pa.list_(pa.struct([("bucket", pa.int32()), ("units", pa.string())])))]
            )
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                if ids and size + len(text) > chunk:
                    yield flush()
                    pa.default_memory_pool().release_unused()
                    ids, digests, texts, size = [], [], [], 0
                ids.append(doc_id)
                digests.append(sha256(text.encode()).digest()[:16])
                texts.append(text)
                size += len(text)
        if ids:
            yield flush()
        pa.default_memory_pool().release_unused()

    def hand_back(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        """The pieces of each chunk's stretches of one bucket, in the chunk's order."""
        pieces_of = dict(zip(known.column("unit").to_pylist(), known.column("ids").to_pylist(), strict=True))
        rows = []
        for made, units in zip(asked.column("chunk").to_pylist(), asked.column("units").to_pylist(), strict=True):
            own = [pieces_of[u] for u in units.split("\0")]
            rows.append((made, press(np.array([len(x) for x in own])), press(np.array([i for x in own for i in x]))))
        made, sizes, ids = zip(*rows, strict=True)
        return pa.table([pa.array(made, pa.int64()), pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array(sizes), pa.array(ids)], ["chunk", "bucket", "sizes", "ids"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def both(index: np.ndarray, sizes: np.ndarray, values: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Runs of ``index`` (``per`` entries each) replaced by the values they stand for: sizes of the runs, values."""
            begin = np.cumsum(sizes) - sizes
            chosen = sizes[index]
            ends = np.r_[0, np.cumsum(chosen)]
            stop = np.cumsum(per)
            return ends[stop] - ends[stop - per], values[ragged(begin[index], chosen)]

        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                blob = {name: unpress(row[name].as_py()) for name in ("refs", "per_doc", "inner", "per_word", "own", "per_own")}
                back = sorted(row["back"].as_py() or [], key=lambda x: x["bucket"])
                sizes = np.concatenate([*(unpress(x["sizes"]) for x in back), blob["per_own"]])
                values = np.concatenate([*(unpress(x["ids"]) for x in back), blob["own"]]).astype(np.int32)
                word_sizes, word_values = both(blob["inner"], sizes, values, blob["per_word"])
                digests = row["digests"].as_py()
                doc_ids, stop = row["doc_ids"].values, np.cumsum(blob["per_doc"])
                for a in range(0, len(digests), 1000):
                    b = min(a + 1000, len(digests))
                    per = blob["per_doc"][a:b]
                    refs = blob["refs"][stop[a] - per[0] : stop[b - 1]]
                    counts, out = both(refs, word_sizes, word_values, per)
                    ends = np.r_[0, np.cumsum(counts)].astype(np.int32)
                    numbers = out.tolist()
                    trips = [
                        sha256(b"".join([texts_of[i] for i in numbers[x:y]])[1:]).digest()[:16] == d
                        for x, y, d in zip(ends[:-1].tolist(), ends[1:].tolist(), digests[a:b], strict=True)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids.slice(a, b - a), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(out)), pa.array(trips)],
                        ["doc_id", "n_pieces", "ids", "round_trip"],
                    )
                pa.default_memory_pool().release_unused()

    blobs = ", ".join(f"{name} binary" for name in ("refs", "per_doc", "inner", "per_word", "own", "per_own"))
    # In buckets, so that the chunks with their references stay where they are and only stretches and pieces travel.
    chunks = stored_in_buckets(
        documents.select("doc_id", "text").mapInArrow(
            gather, f"chunk long, doc_ids array<{kind}>, digests array<binary>, {blobs}, dealt array<struct<bucket: int, units: string>>"
        ),
        "chunk",
        partitions,
    )
    asked = chunks.select("chunk", F.inline("dealt")).repartition(partitions, "bucket")
    # The aggregate needs every column of ``asked``, so that both uses share one shuffle.
    units = asked.select("bucket", "chunk", F.explode(F.split("units", r"\x00")).alias("unit"))
    known = encode_units(units.groupBy("bucket", "unit").agg(F.max("chunk").alias("last")).where("last is not null").select("bucket", "unit"), pieces)
    back = (
        asked.groupBy("bucket").cogroup(known.withColumnRenamed("bucket", "of").groupBy("of")).applyInArrow(hand_back, "chunk long, bucket int, sizes binary, ids binary")
        .repartition(partitions, "chunk")
        .groupBy("chunk").agg(F.collect_list(F.struct("bucket", "sizes", "ids")).alias("back"))
    )
    return chunks.drop("dealt").join(back, "chunk", "left").mapInArrow(assemble, f"doc_id {kind}, n_pieces long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, text`` of rows with ``ids``; null ids give null, none give an empty text. What isn't UTF-8 becomes replacement characters."""
    texts = read_pieces(model).texts()

    @F.arrow_udf("string")
    def join(ids: pa.Array) -> pa.Array:
        return pa.array([None if x is None else b"".join([texts[i] for i in x])[1:].decode(errors="replace") for x in ids.to_pylist()], pa.string())

    return encoded.select("doc_id", join("ids").alias("text"))


@query("op7_pieces")
def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
