"""Alignment of two tokenizers over the same bytes.

Byte offsets where tokens of both end cut a text into groups; tokens whose bytes overlap are linked. Most
groups are one token of each with the same bytes: which B id has an A id's bytes is a fixed array, so such
links are counted in vectors of A's vocabulary length. Only links of irregular groups are pairs that
are shuffled, and each chunk of documents counts its own pairs first. Counts come back to a chunk as
one number for each of its pairs; documents hold references to them.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatseam.llm.common import stored, table
from chatseam.llm.registry import query

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# A chunk is closed once it holds this many bytes of text or this many links; its pairs are held in memory.
CHUNK_BYTES, CHUNK_LINKS = 1 << 25, 1 << 24
# Fixed value: the pattern that splits text before merges, part of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Tokenizers:
    """``ranks`` (A): byte-level merges, the same vocabulary and ids as its JSON form. ``model`` (B): pieces with byte fallback."""

    ranks: str = RANKS
    model: str = MODEL

    def a(self):
        import tiktoken

        with open(self.ranks, "rb") as file:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})

    def b(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.model)

    def a_bytes(self) -> list[bytes]:
        with open(self.ranks, "rb") as file:
            tokens = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, file)}
        return [tokens.get(k, b"") for k in range(max(tokens) + 1)]

    def b_bytes(self) -> list[bytes]:
        pieces = self.b()
        return [
            bytes([int(pieces.id_to_piece(k)[3:5], 16)]) if pieces.is_byte(k)
            else b"" if pieces.is_control(k) or pieces.is_unknown(k)
            else pieces.id_to_piece(k).replace("▁", " ").encode()
            for k in range(len(pieces))
        ]


def identity(a_bytes: list[bytes], b_bytes: list[bytes]) -> np.ndarray:
    """For each A id the B id with the same bytes, a piece before a bare byte; -1 if there is none."""
    by_bytes: dict[bytes, int] = {}
    for k, data in reversed(list(enumerate(b_bytes))):
        if data and not (len(data) == 1 and data in by_bytes):
            by_bytes[data] = k
    return np.array([by_bytes.get(data, -1) if data else -1 for data in a_bytes], np.int64)


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of A and of B tokens, their number, and the linked tokens, from the byte offsets where tokens end.

    Every offset where a token of either ends is the end of the overlap of exactly one pair.
    """
    both = np.intersect1d(a_ends, b_ends, assume_unique=True)
    ends = np.union1d(a_ends, b_ends)
    return (
        np.searchsorted(both, a_ends), np.searchsorted(both, b_ends), both, np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    )


class GroupText:
    """Digests of ``a1,a2|b1;a3|b2,b3`` from ids and groups."""

    def __init__(self, n_a: int, n_b: int):
        self.a = np.array([f"{k}{end}" for k in range(n_a) for end in (",", "|")], object)
        self.b = np.array([f"{k}{end}" for k in range(n_b) for end in (",", ";")], object)

    def digest(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, n: int) -> str:
        a_until, b_until = np.cumsum(np.bincount(a_group, minlength=n)), np.cumsum(np.bincount(b_group, minlength=n))
        out = np.empty(len(a) + len(b), object)
        b_before = np.concatenate(([0], b_until[:-1]))
        out[np.arange(len(a)) + b_before[a_group]] = self.a[2 * a + (np.arange(len(a)) == a_until[a_group] - 1)]
        out[np.arange(len(b)) + a_until[b_group]] = self.b[2 * b + (np.arange(len(b)) == b_until[b_group] - 1)]
        return sha256("".join(out.tolist())[:-1].encode()).hexdigest()


_CHUNKED = (
    "chunk string, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, same array<int>, same_n array<int>,"
    " other array<int>, other_n array<int>, a array<int>, b array<int>, n array<long>"
)


def _lists(arrays: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    sizes = [0 if x is None else len(x) for x in arrays]
    values = [x for x in arrays if x is not None]
    flat = pa.array(np.concatenate(values) if values else np.empty(0, np.int64)).cast(kind)
    missing = np.array([x is None for x in arrays], bool)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), flat, mask=pa.array(missing))


def aligned_chunks(documents: DataFrame, tokenizers: Tokenizers = Tokenizers()) -> DataFrame:
    """Documents with their links, followed by a row for each chunk with what it counts.

    A document refers to its same-bytes links by A id (``same``, ``same_n``) and to the others by their place
    among its chunk's pairs (``other``, ``other_n``). A chunk's row has no ``n_a``; its ``a, b, n`` are its pairs,
    ``same, other_n`` its vector of same-bytes links as A ids and counts.
    """
    kind = dict(documents.dtypes)["doc_id"]
    run = uuid.uuid4().hex

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a_encoder, b_encoder = tokenizers.a(), tokenizers.b()
        a_bytes, b_bytes = tokenizers.a_bytes(), tokenizers.b_bytes()
        a_sizes, b_sizes = (np.array(list(map(len, x)), np.int64) for x in (a_bytes, b_bytes))
        same_as, texts_of, width = identity(a_bytes, b_bytes), GroupText(len(a_bytes), len(b_bytes)), len(b_bytes)
        part, number = TaskContext.get().partitionId(), 0
        none, fields = np.empty(0, np.int64), [f.split()[0] for f in _CHUNKED.format(kind="long").split(", ")]

        def rows(ids: pa.Array, docs: list[tuple]) -> pa.RecordBatch:
            chunk = pa.array([f"{run}-{part}-{number}"] * len(docs), pa.string())
            cols = list(zip(*docs, strict=True)) if docs else [[]] * 11
            plain = [pa.array(cols[k], pa.int64()) for k in range(3)] + [pa.array(cols[3], pa.string())]
            lists = [_lists(list(cols[k]), pa.int32()) for k in range(4, 10)] + [_lists(list(cols[10]), pa.int64())]
            return pa.RecordBatch.from_arrays([chunk, ids, *plain, *lists], fields)

        known: dict[int, int] = {}
        totals, vector, size, links = [], np.zeros(len(a_bytes), np.int64), 0, 0

        def counts(id_type: pa.DataType) -> pa.RecordBatch:
            pairs = np.fromiter(known, np.int64, len(known))
            found = np.flatnonzero(vector)
            n = np.zeros(len(known), np.int64)
            for place, times in totals:
                n[place] += times
            return rows(pa.nulls(1, id_type), [(None, None, None, None, found, None, None, vector[found], pairs // width, pairs % width, n)])

        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                piece = batch.slice(at, 100)
                texts = piece.column(1).to_pylist()
                b_ids = b_encoder.encode([text or "" for text in texts], num_threads=1)
                docs = []
                for text, b_list in zip(texts, b_ids, strict=True):
                    data = b" " + (text or "").encode()
                    size += len(data) + 64
                    a_list = a_encoder.encode_ordinary(" " + text) if text else []
                    if not text or b"".join([a_bytes[k] for k in a_list]) != data or b"".join([b_bytes[k] for k in b_list]) != data:
                        docs.append((0, 0, 0, "", none, none, none, none, None, None, None))
                        continue
                    a, b = np.array(a_list, np.int64), np.array(b_list, np.int64)
                    a_group, b_group, both, a_at, b_at = align(np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b]))
                    linked_a, linked_b = a[a_at], b[b_at]
                    fast = same_as[linked_a] == linked_b
                    same, same_n = np.unique(linked_a[fast], return_counts=True)
                    vector[same] += same_n
                    pairs, other_n = np.unique(linked_a[~fast] * width + linked_b[~fast], return_counts=True)
                    other = np.fromiter((known.setdefault(pair, len(known)) for pair in pairs.tolist()), np.int64, len(pairs))
                    totals.append((other, other_n))
                    links += len(linked_a)
                    docs.append((len(a), len(b), len(both), texts_of.digest(a, b, a_group, b_group, len(both)), same, same_n, other, other_n, None, None, None))
                yield rows(piece.column(0), docs)
                if size > CHUNK_BYTES or links > CHUNK_LINKS:
                    yield counts(batch.column(0).type)
                    number += 1
                    known, totals, size, links = {}, [], 0, 0
                    vector = np.zeros(len(a_bytes), np.int64)
        if known or vector.any():
            yield counts(piece.column(0).type)

    return documents.select("doc_id", "text").mapInArrow(chunks, _CHUNKED.format(kind=kind))


def pair_counts(chunks: DataFrame, same_as: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """``a, b, n`` of the pairs that are not of the same bytes, and the vector of those that are."""
    own = chunks.where("n_a is null")
    vector = np.zeros(len(same_as), np.int64)
    for row in own.select(F.inline(F.arrays_zip("same", "other_n"))).groupBy("same").agg(F.sum(F.col("other_n").cast("bigint")).alias("n")).collect():
        vector[row["same"]] = row["n"]
    pairs = own.select(F.inline(F.arrays_zip("a", "b", "n"))).groupBy("a", "b").agg(F.sum("n").alias("n"))
    return stored(pairs), vector


def alignment(documents: DataFrame, tokenizers: Tokenizers = Tokenizers()) -> tuple[DataFrame, DataFrame]:
    """Documents with their digests, and the pairs ``a, b, n`` of all of them.

    Per document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: a link is best if
    its pair's count is the highest of its B id. Texts that are null, empty or whose tokens don't give the text
    back have zeros and no digest. Repeated rows and null ids each come back, and count each. An empty
    table gives empty results; other columns are not read.

    To the driver and the workers go two vectors, as long as the vocabularies. Texts are encoded once.
    """
    spark = documents.sparkSession
    same_as = identity(tokenizers.a_bytes(), tokenizers.b_bytes())
    chunks = stored(aligned_chunks(documents, tokenizers))
    pairs, vector = pair_counts(chunks, same_as)
    best = np.zeros(max(same_as.max() + 1, len(tokenizers.b_bytes())), np.int64)
    for row in pairs.groupBy("b").agg(F.max("n").alias("n")).collect():
        best[row["b"]] = row["n"]
    np.maximum.at(best, same_as[same_as >= 0], vector[same_as >= 0])
    is_best = (vector == best[same_as]) & (same_as >= 0)
    tops = spark.createDataFrame([(k, int(n)) for k, n in enumerate(best.tolist()) if n], "b int, most long")

    # A chunk's pairs meet their counts and come back as two arrays in the chunk's order.
    own = chunks.where("n_a is null").select("chunk", F.posexplode(F.arrays_zip("a", "b")).alias("place", "pair")).select("chunk", "place", "pair.*")
    counted = (
        own.join(pairs, ["a", "b"]).join(F.broadcast(tops), "b")
        .groupBy("chunk")
        .agg(F.array_sort(F.collect_list(F.struct("place", "n", (F.col("n") == F.col("most")).alias("best")))).alias("pairs"))
        .select(F.col("chunk").alias("of"), F.col("pairs.n").alias("n"), F.col("pairs.best").alias("best"))
    )
    kind = dict(documents.dtypes)["doc_id"]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def add_up(docs: pa.Table, counts: pa.Table) -> pa.Table:
        if counts.num_rows:
            n, top = (counts.column(name)[0].values.to_numpy(zero_copy_only=False) for name in ("n", "best"))
        else:
            n, top = np.empty(0, np.int64), np.empty(0, bool)
        links, bests, sums = [], [], []
        lists = {}
        for name in ("same", "same_n", "other", "other_n"):
            column = docs.column(name).combine_chunks()
            lists[name] = (column.values.to_numpy(zero_copy_only=False).astype(np.int64), column.offsets.to_numpy())
        for row in range(docs.num_rows):
            same, same_n, other, other_n = (values[offsets[row] : offsets[row + 1]] for values, offsets in lists.values())
            links.append(int(same_n.sum() + other_n.sum()))
            bests.append(int(same_n[is_best[same]].sum() + other_n[top[other]].sum()))
            sums.append(int((same_n * vector[same]).sum() + (other_n * n[other]).sum()))
        return pa.table(
            [docs.column("doc_id"), docs.column("n_a"), docs.column("n_b"), docs.column("n_groups"), pa.array(links, pa.int64()),
             pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), docs.column("groups_sha256")], names
        )

    docs = chunks.where("n_a is not null").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "same", "same_n", "other", "other_n")
    result = docs.groupBy("chunk").cogroup(counted.groupBy("of")).applyInArrow(add_up, schema)
    same = spark.createDataFrame(
        [(k, int(same_as[k]), int(n)) for k, n in enumerate(vector.tolist()) if n], "a int, b int, n long"
    )
    return result, pairs.unionByName(same)


@query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))[0]
