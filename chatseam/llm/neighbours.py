"""Approximate nearest neighbours in a forest of hash prefixes.

Each tree gives a vector a string of bits (signs of random projections); a tree is the sorted array
of these strings. A query descends to the longest prefix it shares with enough vectors: all trees
ascend together, one bit at a time, until the vectors under its prefixes are enough in sum. What
lies under a prefix is a run of the sorted array. Runs are scored in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatseam.llm.common import stored, table
from chatseam.llm.registry import query

TREES = 24
BITS = 14
BLOCK = 8192


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` (doubles) of vectors with an id that aren't null or zero and hold finite components only."""
    return vectors.where("vec_id is not null").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).where(
        F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0)
    )


def _hashes(x: np.ndarray, largest: float, index: bool, trees: int, bits: int, seed: int) -> np.ndarray:
    """Bit strings (rows, trees). Vectors get one more component that makes all norms equal, so that the
    largest inner product is the smallest angle; queries get 0 there."""
    more = np.sqrt(np.maximum(0, largest**2 - (x * x).sum(axis=1))) if index else np.zeros(len(x))
    planes = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, trees * bits))
    signs = (np.c_[x, more] @ planes > 0).reshape(len(x), trees, bits)
    return signs @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _repeat(x: np.ndarray) -> pa.Array:
    width = x.shape[1] if x.ndim == 2 else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(x.ravel()))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, trees: int = TREES, bits: int = BITS, share: float = 1.0,
    least: int = 2000, seed: int = 7,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every query row, itself left out.

    A query ascends until the vectors under its prefixes, counted in each tree, are ``least`` and
    ``share`` times all vectors at least. Up to ``least`` vectors all are candidates and the result
    is exact. Equal vectors are one entry with its ``k + 1`` smallest ids, which is all that a result
    can hold of them. Vectors of ``usable`` take part, so rows with a null id don't; each length is searched among its own, one
    search after the other, so lengths should be few. Rows of equal id are rows of their own only
    by their vector. Fewer than ``k`` candidates give fewer rows, an empty table none.
    """
    rows = stored(usable(vectors).withColumn("_query", F.coalesce(is_query, F.lit(False))))
    sizes = [r[0] for r in rows.select(F.size("v").alias("n")).distinct().collect()]
    found = [_nearest(rows.where(F.size("v") == n), k, trees, bits, share, least, seed) for n in sorted(sizes)]
    found = found or [_nearest(rows, k, trees, bits, share, least, seed)]
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    return found[0]


def _nearest(rows: DataFrame, k: int, trees: int, bits: int, share: float, least: int, seed: int) -> DataFrame:
    """:func:`nearest` among vectors of one length."""
    first = Window.partitionBy("v").orderBy("vec_id")
    classes = stored(
        rows.dropDuplicates(["v", "vec_id"])
        .withColumn("_place", F.row_number().over(first))
        .where(F.col("_place") <= k + 1)
        .groupBy("v")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        .join(rows.where("_query").select("v").distinct().withColumn("_query", F.lit(True)), "v", "left")
        .select(F.get("ids", F.lit(0)).alias("id"), "ids", "v", F.coalesce("_query", F.lit(False)).alias("q"))
    )
    total, largest = classes.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    largest = float(np.sqrt(largest or 0.0))
    wanted = max(least, int(share * total)) if total > least else trees * total + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                strings = _hashes(_matrix(batch.column(0)), largest, True, trees, bits, seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(trees, dtype=np.int32), len(strings))), pa.array(strings.ravel())], ["tree", "bits"])

    # The sorted arrays as counts: trees * 2**bits numbers at most, whatever the number of vectors.
    counted = classes.select("v").mapInArrow(place, "tree int, bits long").groupBy("tree", "bits").count().toArrow()
    sizes = np.zeros((trees, 1 << bits), dtype=np.int64)
    sizes[counted.column("tree").to_numpy(), counted.column("bits").to_numpy()] = counted.column("count").to_numpy()
    before = np.c_[np.zeros(trees, dtype=np.int64), np.cumsum(sizes, axis=1)]
    segment_bits = int(np.clip(np.ceil(np.log2(max(1, total / BLOCK))), 0, bits))
    per_segment = np.diff(before[:, :: 1 << (bits - segment_bits)], axis=1)
    blocks = np.maximum(1, -(-per_segment // BLOCK))

    def depths(strings: np.ndarray) -> np.ndarray:
        """The longest prefix, the same in all trees, under which there are enough."""
        depth = np.zeros(len(strings), dtype=np.int64)
        tree = np.arange(trees)
        for d in range(bits, 0, -1):
            low = strings >> (bits - d) << (bits - d)
            found = (before[tree, low + (1 << (bits - d))] - before[tree, low]).sum(axis=1)
            depth[(depth == 0) & (found >= wanted)] = d
        return depth

    fields = "tree int, segment int, block int, kind int, low long, high long, id long, v array<double>"
    names = [f.split()[0] for f in fields.split(", ")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = bits - segment_bits
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x, asks = batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            strings = _hashes(x, largest, True, trees, bits, seed)
            for tree in range(trees):
                low = strings[:, tree]
                segment = low >> shift
                block = ids % blocks[tree, segment]
                full = np.full(len(ids), tree, dtype=np.int32)
                columns = (full, segment.astype(np.int32), block.astype(np.int32), np.zeros(len(ids), np.int32), low, low, ids)
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), _repeat(x)], names)
            if not asks.any():
                continue
            ids, x = ids[asks], x[asks]
            strings = _hashes(x, largest, False, trees, bits, seed)
            depth = depths(strings)
            # Depth 0 is all vectors: one tree holds them.
            for tree in range(trees):
                for n in np.flatnonzero((depth > 0) | (tree == 0)):
                    width = bits - depth[n]
                    low = strings[n, tree] >> width << width
                    high = low + (1 << width)
                    segments = np.arange(low >> shift, max((high - 1) >> shift, low >> shift) + 1)
                    where = [(s, b) for s in segments.tolist() if per_segment[tree, s] for b in range(blocks[tree, s])]
                    if where:
                        s, b = (np.array(c, dtype=np.int32) for c in zip(*where, strict=True))
                        m = len(s)
                        columns = (np.full(m, tree, np.int32), s, b, np.ones(m, np.int32), np.full(m, low), np.full(m, high), np.full(m, ids[n]))
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), _repeat(np.tile(x[n], (m, 1)))], names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come block by block: first its vectors, sorted by bits, then the queries."""
        at, held, run = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("tree", "segment", "block", "kind")], axis=1)
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part, place_ = batch.slice(a, b - a), tuple(key[a, :3])
                if place_ != at:
                    at, held, run = place_, [], None
                low, ids, x = part.column(4).to_numpy(), part.column(6).to_numpy(), _matrix(part.column(7))
                if key[a, 3] == 0:
                    held.append((low, ids, x))
                    continue
                if run is None:
                    if not held:
                        continue
                    run = [np.concatenate(c) for c in zip(*held, strict=True)]
                strings, members, matrix = run
                high = part.column(5).to_numpy()
                for lo, hi in sorted({*zip(low.tolist(), high.tolist(), strict=True)}):
                    i, j = np.searchsorted(strings, [lo, hi])
                    asking = np.flatnonzero((low == lo) & (high == hi))
                    for c in range(0, len(asking) if j > i else 0, 256):
                        own = asking[c : c + 256]
                        scores = x[own] @ matrix[i:j].T
                        out = []
                        for q, row in zip(ids[own].tolist(), scores, strict=True):
                            best = np.arange(len(row))
                            if len(row) > k + 1:
                                best = np.flatnonzero(row >= np.partition(row, len(row) - k - 1)[len(row) - k - 1])
                            best = best[np.lexsort((members[i:j][best], -row[best]))][: k + 1]
                            out.append((np.full(len(best), q), members[i:j][best], row[best]))
                        q, m, s = (np.concatenate(z) for z in zip(*out, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(m), pa.array(s)], ["query", "id", "score"])

    found = (
        classes.select("id", "v", "q")
        .mapInArrow(deal, fields)
        .repartition("tree", "segment", "block")
        .sortWithinPartitions("tree", "segment", "block", "kind", "low", "id")
        .mapInArrow(score, "query long, id long, score double")
        .groupBy("query", "id")
        .agg(F.max("score").alias("score"))
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    top = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
    every = top.join(classes.select("id", "ids"), "id").select("query", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = (
        every.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
        .groupBy("query").agg(F.array_sort(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("near"))
    )
    by_vector = classes.where("q").select(F.col("id").alias("query"), "v").join(lists, "query").select("v", "near")
    asked = rows.where("_query").select(F.col("vec_id").alias("query_id"), "v").join(by_vector, "v")
    others = F.slice(F.filter("near", lambda n: ~n["vec_id"].eqNullSafe(F.col("query_id"))), 1, k)
    return asked.select("query_id", F.posexplode(others).alias("_at", "_near")).select(
        "query_id", (F.col("_at") + 1).alias("rank"), F.col("_near.vec_id").alias("vec_id"), F.col("_near.score").alias("score")
    )


@query("op10_neighbours")
def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
