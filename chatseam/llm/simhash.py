"""SimHash near-deduplication.

Fingerprints of 64 bits are cut into blocks. Two that differ in few bits agree in many whole
blocks, so every pair within reach shares a choice of blocks (pigeonhole), and only fingerprints
with such a choice in common are compared. Equal fingerprints are one row from there on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatseam.llm.common import carried, restored, small_batches, stored, table
from chatseam.llm.components import components
from chatseam.llm.registry import query


def shingle_hashes(data: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``size`` words, lower-cased and joined by spaces; of all words if fewer."""
    words = data.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.r_[0, ends[:-1]]
    width = min(size, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in spans], dtype=np.uint64)


def simhash(data: bytes | None, size: int = 3) -> int:
    """The bits that are set in over half of the shingles' hashes; 0 without words."""
    hashes = shingle_hashes(data or b"", size)
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((counts * 2 > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(documents: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id, fp`` of every row; null text has no words."""

    @F.arrow_udf("bigint")
    def fingerprint(text: pa.Array) -> pa.Array:
        return pa.array([simhash(data, size) for data in text.to_pylist()], pa.int64())

    small_batches(documents.sparkSession)
    return documents.select("doc_id", fingerprint(F.col("text").cast("binary")).alias("fp"))


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of all choices of ``blocks - distance`` blocks: pairs within the distance agree under one at least."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def whole_buckets(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by ``choice, key``, cut between buckets only; the first two are ``choice, key``."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(c).to_numpy() for c in columns]
        last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        # Only the bucket still open is held; the others are done.
        if cut or (held and (held[-1][0][-1], held[-1][1][-1]) != (rows[0][0], rows[1][0])):
            done = [*held, [x[:cut] for x in rows]]
            yield [np.concatenate(x) for x in zip(*done, strict=True)]
            held = []
        held.append([x[cut:] for x in rows])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def bucket_links(keyed: DataFrame, distance: int, width: int) -> DataFrame:
    """``a, b``: links that connect all ids of ``choice, key, id, w0 ..`` that share a bucket and lie within the distance.

    A bucket is a choice and a key. A few members are compared directly; larger ones are searched by
    removal: what is found near leaves the pool, so a dense bucket shrinks fast and gives a
    spanning forest, one link fewer than members at most, never all its pairs.
    """
    few = 8
    columns = ["choice", "key", "id", *(f"w{k}" for k in range(width))]

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        # As unsigned: of a negative number numpy counts the bits of its absolute value.
        return np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=-1) <= distance

    def forest(ids: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while len(ids) > 1:
            front, ids, prints = [(ids[:1], prints[:1])], ids[1:], prints[1:]
            while front and len(ids):
                for one, x in zip(*front.pop(), strict=True):
                    found = near(prints, x)
                    if found.any():
                        yield np.full(int(found.sum()), one), ids[found]
                        front.append((ids[found], prints[found]))
                        ids, prints = ids[~found], prints[~found]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(choice: np.ndarray, key: np.ndarray, ids: np.ndarray, *words: np.ndarray) -> pa.RecordBatch:
            prints = np.stack(words, axis=1)
            cuts = np.flatnonzero(np.r_[True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1]), True])
            lengths = np.diff(cuts)
            bucket = np.repeat(np.arange(len(lengths)), lengths)
            small = np.repeat(lengths <= few, lengths)
            pairs = [(ids[:0], ids[:0])]
            for step in range(1, few):
                at = np.flatnonzero((bucket[step:] == bucket[:-step]) & small[step:])
                at = at[near(prints[at], prints[at + step])]
                pairs.append((ids[at], ids[at + step]))
            for start, length in zip(cuts[:-1][lengths > few].tolist(), lengths[lengths > few].tolist(), strict=True):
                pairs.extend(forest(ids[start : start + length], prints[start : start + length]))
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for choice, key, ids, *words in whole_buckets(batches, columns):
            yield links(choice, key, ids, *words)

    small_batches(keyed.sparkSession, 10_000)
    return (
        keyed.select(*columns)
        .repartition("choice", "key")
        .sortWithinPartitions("choice", "key", "id")
        .mapInArrow(search, "a long, b long")
        .distinct()
    )


def bucket_pairs(keyed: DataFrame, distance: int, width: int) -> DataFrame:
    """``a, b``: all pairs of ids of ``choice, key, root, id, w0 ..`` of one bucket and two roots that lie within the distance."""
    columns = ["choice", "key", "root", "id", *(f"w{k}" for k in range(width))]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for choice, key, roots, ids, *words in whole_buckets(batches, columns):
            prints = np.stack(words, axis=1)
            ends = np.flatnonzero(np.r_[(choice[1:] != choice[:-1]) | (key[1:] != key[:-1]), True]) + 1
            pairs, waiting = [], 0
            start = 0
            for end in ends.tolist():
                for k in range(start, end - 1):
                    other = k + 1 + np.flatnonzero(roots[k + 1 : end] != roots[k])
                    found = other[np.bitwise_count((prints[other] ^ prints[k]).view(np.uint64)).sum(axis=1) <= distance]
                    if len(found):
                        pairs.append((np.full(len(found), ids[k]), ids[found]))
                        waiting += len(found)
                    if waiting > 100_000:
                        yield batch_of(pairs)
                        pairs, waiting = [], 0
                start = end
            if pairs:
                yield batch_of(pairs)

    small_batches(keyed.sparkSession, 10_000)
    return (
        keyed.select(*columns)
        .repartition("choice", "key")
        .sortWithinPartitions("choice", "key", "id")
        .mapInArrow(search, "a long, b long")
        .distinct()
    )


def near_links(prints: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """``a, b``: links that connect all fingerprints of ``prints`` (distinct ``fp``) within the distance."""
    return bucket_links(print_buckets(prints.withColumn("id", F.col("fp")), distance, blocks), distance, 1)


def print_buckets(rows: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """``rows`` once for every choice of blocks: ``choice, key``, the fingerprint ``fp`` as ``w0``, and the other columns."""
    masks = F.array(*(F.lit(m).cast("bigint") for m in block_masks(distance, blocks)))
    others = [name for name in rows.columns if name != "fp"]
    return rows.select("*", F.posexplode(masks).alias("choice", "mask")).select(
        "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), *others, F.col("fp").alias("w0")
    )


def near_duplicates(documents: DataFrame, size: int = 3, distance: int = 3, blocks: int = 6) -> DataFrame:
    """``doc_id, fp, component_id`` of every row.

    Fingerprints link at ``distance`` differing bits or fewer; ``component_id`` is the smallest
    ``doc_id`` reachable over links. Documents without words share fingerprint 0 and link like any
    other. Null ids take part, but name a component only if it has no other id (then it is null).
    Repeated rows each come back. Very long texts are hashed in slices. An empty table gives an empty result.
    """
    rows = stored(fingerprints(documents, size))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = near_links(classes.select("fp"), distance, blocks)
    roots = components(links, "a", "b")
    linked = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        classes["fp"].alias("_fp"), "first", F.coalesce("root", classes["fp"]).alias("root")
    )
    named = stored(linked)
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = named.join(names, "root").select("_fp", "component_id")
    return rows.join(by_print, rows["fp"] == by_print["_fp"]).select("doc_id", "fp", "component_id")


def shingle_set(data: bytes | None, size: int) -> np.ndarray:
    """The distinct shingles' hashes in order."""
    return np.unique(shingle_hashes(data or b"", size))


def wide_simhash(hashes: np.ndarray, words: int) -> np.ndarray:
    """A fingerprint of ``words`` times 64 bits; every word takes its bits from the shingles' hashes mixed anew."""
    salts = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros(64 * words, dtype=np.int64)
    for k in range(0, len(hashes), 2048):
        x = hashes[k : k + 2048, None] + salts
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits((counts * 2 > len(hashes)).astype(np.uint8), bitorder="little").view(np.int64)


def compared_sets(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``a, b, near``: whether the ``shingles`` of the two in ``sets`` (``id, shingles``) have that Jaccard similarity at least."""
    for end in ("a", "b"):
        links = links.join(sets.select(F.col("id").alias(end), F.col("shingles").alias(f"_{end}")), end)
    both = F.size(F.array_intersect("_a", "_b"))
    # In whole thousandths, so that a similarity of exactly four fifths counts.
    near = both * 1000 >= (F.size("_a") + F.size("_b") - both) * round(similarity * 1000)
    return links.select("a", "b", near.alias("near"))


def similar_links(
    classes: DataFrame, prints: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, distance: int, compared: int, whole: int, words: int, block_bits: int,
    linked: bool = False,
) -> DataFrame:
    """``a, b``: verified links that connect all ids of ``classes`` (``id, print``) that the fingerprints propose and the sets confirm.

    ``prints`` (``id, fp``) are their fingerprints of 64 bits, which propose at 3 bits, or with ``linked`` link at once; those
    of ``classes`` propose as follows.

    First a forest of every bucket is verified. Where a link of it fails, what it held together falls into
    parts; these are searched again for all pairs of two parts, which are verified too. So no
    pair that shares a block and lies within the distances is left out. The first search compares ``compared`` words
    (``distance``), the second, which has few rows but may meet many pairs, all of them (``whole``).
    """
    per_word = 64 // block_bits
    mask = F.lit((1 << block_bits) - 1).cast("bigint")
    blocks = F.array(
        *(F.shiftrightunsigned(F.get("print", F.lit(k // per_word)), k % per_word * block_bits).bitwiseAND(mask) for k in range(words * per_word))
    )

    def keyed(rows: DataFrame, width: int) -> DataFrame:
        prints = (F.get("print", F.lit(k)).alias(f"w{k}") for k in range(width))
        return rows.select(F.posexplode(blocks).alias("choice", "key"), *(c for c in rows.columns if c != "print"), *prints)

    proposed = bucket_links(keyed(classes, compared), distance, compared)
    narrow = stored(bucket_links(print_buckets(prints), 3, 1).where("a != b"))
    proposed = stored(proposed if linked else proposed.union(narrow).distinct())
    nodes = proposed.select(F.col("a").alias("id")).union(proposed.select("b")).distinct()
    sets = stored(sets_of(nodes))
    judged = stored(compared_sets(proposed, sets, similarity))
    links = judged.where("near").select("a", "b")
    if linked:
        links = links.union(narrow)
    roots = components(links, "a", "b")
    parts = stored(sets.select("id").join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root")))
    failed = judged.where("not near").select("a", "b")
    for end in ("a", "b"):
        failed = failed.join(parts.select(F.col("id").alias(end), F.col("root").alias(f"_{end}")), end)
    failed = stored(failed.where("_a != _b").select("_a", "_b").distinct())
    torn = stored(failed.select(F.col("_a").alias("root")).union(failed.select("_b")).distinct())
    if torn.isEmpty():
        return links
    members = parts.join(torn, "root")
    pairs = bucket_pairs(keyed(classes.join(members, "id"), words), whole, words)
    if not linked:
        pairs = pairs.union(bucket_pairs(print_buckets(prints.join(members, "id")), 3, 1)).distinct()
    return links.union(stored(compared_sets(pairs, sets, similarity).where("near").select("a", "b")))


def drop_near_duplicates(
    documents: DataFrame, size: int = 5, distance: int = 80, compared: int = 4, words: int = 16, block_bits: int = 16,
    similarity: float = 0.8, whole: int = 250, linked: bool = False,
) -> DataFrame:
    """One document of each group of near duplicates, unchanged: the one of smallest id.

    Two texts are near duplicates if their sets of ``size``-word shingles have a Jaccard similarity of ``similarity`` at
    least; a group is what such pairs connect. Equal sets are one class from the start. Other pairs are proposed by the
    fingerprints of :func:`near_duplicates` that link at 3 bits, and, as most such copies lie further apart than that, by
    fingerprints of ``words`` times 64 bits, of which at similarity 0.8 about 15 % differ: such copies agree in one of the 64 blocks of
    ``block_bits`` bits in about 99 % of cases. Of these pairs, those whose first ``compared`` words differ in ``distance`` bits at
    most (31 %), or whose words all differ in ``whole`` bits at most (24 %), are verified on the sets themselves: the distances lie
    so far out that they cost almost no pair, and no pair below the similarity links. README has the measured recall.
    With ``linked``, what :func:`near_duplicates` links is a near duplicate too, whatever its similarity: a group is what links of
    either kind connect, so one document of each of its components stays at most.
    Texts without words are copies of each other. Null ids come last and are told apart by text; of repeated
    rows one stays. Very long texts are hashed in slices. An empty table gives an empty result.
    """

    @F.arrow_udf("struct<fp: bigint, set: bigint, print: array<bigint>>")
    def wide(text: pa.Array) -> pa.Array:
        texts = text.to_pylist()
        narrow = pa.array([simhash(data) for data in texts], pa.int64())
        sets = [shingle_set(data, size) for data in texts]
        keys = pa.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], pa.uint64()).view(pa.int64())
        flat = np.concatenate([wide_simhash(x, words) for x in sets]) if sets else np.empty(0, np.int64)
        prints = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * words), pa.array(flat))
        return pa.StructArray.from_arrays([narrow, keys, prints], ["fp", "set", "print"])

    @F.arrow_udf("array<bigint>")
    def shingles(text: pa.Array) -> pa.Array:
        return pa.array([shingle_set(data, size).view(np.int64) for data in text.to_pylist()], pa.list_(pa.int64()))

    small_batches(documents.sparkSession)
    named = carried(documents, "doc_id").withColumns({"_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1)), "_text_id": F.xxhash64("text")})
    rows = stored(
        named.select("_id", "_text_id", wide(F.col("text").cast("binary")).alias("_wide"))
        .select("_id", "_text_id", F.col("_wide.fp").alias("_fp"), F.col("_wide.set").alias("_class"), F.col("_wide.print").alias("_print"))
    )
    classes = stored(rows.groupBy("_class").agg(F.min(F.struct("_id", "_text_id")).alias("first"), F.first("_print").alias("print")))

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = classes.join(nodes, F.col("_class") == F.col("id")).select("id", "first._id", "first._text_id")
        small_batches(documents.sparkSession)
        texts = named.select("_id", "_text_id", "text").join(wanted, ["_id", "_text_id"])
        return texts.select("id", shingles(F.col("text").cast("binary")).alias("shingles")).dropDuplicates(["id"])

    prints = rows.select(F.col("_class").alias("id"), F.col("_fp").alias("fp")).distinct()
    links = similar_links(classes.select(F.col("_class").alias("id"), "print"), prints, sets_of, similarity, distance, compared, whole, words, block_bits, linked)
    roots = components(links, "a", "b")
    linked = stored(
        classes.join(roots, classes["_class"] == roots["node"], "left").select("_class", F.col("first._id").alias("first"), F.coalesce("root", "_class").alias("_root"))
    )
    firsts = linked.groupBy("_root").agg(F.min("first").alias("_first"))
    groups = linked.select("_class", "_root").join(firsts, "_root")
    # Of every group the rows of the smallest id; of those, one text.
    chosen = (
        rows.join(groups, "_class").where(F.col("_id") == F.col("_first"))
        .groupBy("_root", "_id").agg(F.min("_text_id").alias("_text_id")).select("_id", "_text_id")
    )
    place = Window.partitionBy("_id", "_text_id").orderBy("_id")
    return (
        named.join(chosen, ["_id", "_text_id"])
        .withColumn("_place", F.row_number().over(place)).where("_place = 1")
        .select(*restored(documents.columns))
    )


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
