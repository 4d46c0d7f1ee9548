"""Exact neighbour lists: cells around pivots, bounds that keep far cells apart, blocks of bounded size."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatseam.session import saved

# Workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows that meet in one task: queries and candidates of a block; fewer, where their numbers (rows times dimensions) are more than these.
QUERY_ROWS, QUERY_VALUES = 32_768, 2**21
CANDIDATE_ROWS, CANDIDATE_VALUES = 65_536, 2**22
# Distances of a block held at a time.
DISTANCES = 2**21


def neighbour_lists(
    vectors: DataFrame, key: str, vector: str = "embedding", k: int = 10, pivots: int = 64
) -> DataFrame:
    """``(id, neighbour, distance)``: the ``k`` nearest others of each vector, exactly, ties to smaller ids.

    Distances are Euclidean; bring unit vectors for cosine order. ``key`` must be an integer that no
    two rows share. Vectors that are null, empty or hold null or non-finite values take no part, and all others must
    have one length. Equal vectors are searched once, however many copies there are.

    ``pivots`` vectors, chosen by hash, name the cells; they and a few numbers a cell are all the driver sees.
    The triangle inequality bounds how far the ``k`` nearest of a cell can lie, so candidates travel only
    to the cells that may need them. In few dimensions these are few. In many they are nearly all, and the work is that of
    all blocks against all: quadratic, in matrix products of bounded size. Cells that need most rows are
    searched together there, so that a row travels once for a block of queries and not once for every cell.
    """
    clean = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(
        F.col("id").isNotNull()
        & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    # Adding zero turns -0.0 into 0.0, which is the same place.
    placed = clean.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    named = saved(placed.withColumn("place", F.sha2(F.concat_ws(",", F.col("vector").cast("array<string>")), 256)))
    first = Window.partitionBy("place").orderBy("id")
    copies = named.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    # At most k + 1 ids a place, as the window drops the others before the shuffle.
    places = saved(
        copies.groupBy("place")
        .agg(F.min_by("vector", "id").alias("vector"), F.array_sort(F.collect_list("id")).alias("ids"))
        .withColumns({"number": F.monotonically_increasing_id(), "first": F.col("ids")[0]})
    )
    near = _nearest_places(places, k, pivots)
    ids = places.select(F.col("number").alias("other"), "ids")
    named_places = places.select("number", "place")
    listed = (
        near.join(ids, "other")
        .join(named_places, "number")
        .select("place", "distance", F.explode("ids").alias("neighbour"))
        .unionByName(places.select("place", F.lit(0.0).alias("distance"), F.explode("ids").alias("neighbour")))
    )
    # One more than k, as each copy leaves itself out.
    by_distance = Window.partitionBy("place").orderBy("distance", "neighbour")
    lists = (
        listed.withColumn("_n", F.row_number().over(by_distance))
        .where(F.col("_n") <= k + 1)
        .groupBy("place")
        .agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))).alias("list"))
    )
    # A place with many copies is a hot key of the left side only; adaptive execution splits it.
    others = named.select("place", "id").join(lists, "place")
    kept = F.slice(F.filter("list", lambda entry: entry["neighbour"] != F.col("id")), 1, k)
    return others.select("id", F.explode(kept).alias("entry")).select("id", "entry.neighbour", "entry.distance")


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    values = table.column(column).combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _nearest_places(places: DataFrame, k: int, pivots: int) -> DataFrame:
    """``(number, other, distance)``: the ``k`` nearest other places of each place, ties to the smaller first id."""
    spark = places.sparkSession
    chosen = np.array([row.vector for row in places.orderBy("place").limit(pivots).select("vector").collect()])
    if not len(chosen):
        return spark.createDataFrame([], "number long, other long, distance double")

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            matrix = np.vstack(batch["vector"].to_numpy())
            distances = np.stack([np.sqrt(((matrix - pivot) ** 2).sum(axis=1)) for pivot in chosen], axis=1)
            cell = distances.argmin(axis=1)
            yield batch.assign(cell=cell, reach=distances[np.arange(len(batch)), cell])

    schema = "place string, number long, first long, vector array<double>, cell long, reach double"
    cells = saved(places.select("place", "number", "first", "vector").mapInPandas(to_cells, schema))
    closest = Window.partitionBy("cell").orderBy("reach", "place")
    sizes = cells.groupBy("cell").agg(F.max("reach").alias("radius"), F.count(F.lit(1)).alias("rows"))
    inner = (
        cells.select("cell", "reach", "place")
        .withColumn("_n", F.row_number().over(closest))
        .where(F.col("_n") <= k + 1)
        .groupBy("cell")
        .agg(F.collect_list("reach").alias("inner"))
    )
    # One row a cell with k + 1 numbers: bounded by the parameters.
    facts = sizes.join(inner, "cell").orderBy("cell").collect()
    routes = _routes(chosen, facts, k)
    routes_frame = F.broadcast(spark.createDataFrame(routes, "cell long, target long, least double"))
    routed = cells.select("cell", "reach").join(routes_frame, "cell").where(F.col("reach") >= F.col("least"))
    arriving = {row.target: row.rows for row in routed.groupBy("target").agg(F.count(F.lit(1)).alias("rows")).collect()}
    blocks = _blocks({row.cell: row.rows for row in facts}, arriving, chosen.shape[1], spark.sparkContext.defaultParallelism)
    group_of = {target: group for group, targets, _, _ in blocks for target in targets}
    least: dict[tuple[int, int], float] = {}
    for cell, target, reach in routes:
        key = cell, group_of[target]
        least[key] = min(reach, least.get(key, reach))
    to_group = F.broadcast(spark.createDataFrame(list(group_of.items()), "cell long, target long"))
    to_groups = F.broadcast(spark.createDataFrame([(*key, reach) for key, reach in least.items()], "cell long, target long, least double"))
    slices = F.broadcast(spark.createDataFrame([(g, q, c) for g, _, q, c in blocks], "target long, query_parts long, candidate_parts long"))
    block = ["target", "query_part", "candidate_part"]
    # Named, so that no small shuffle makes a few tasks of them: what travels is little against the work on it.
    tasks = 2 * sum(q * c for _, _, q, c in blocks)

    def spread(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one slice of its own side, once for every slice of the other side."""
        mine = F.pmod(F.xxhash64("place"), F.col(f"{own}_parts")).alias(f"{own}_part")
        all_others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}_parts") - 1)).alias(f"{other}_part")
        # New names, as both sides of the cogroup come from one table.
        named = (F.col("number").alias("name"), F.col("first").alias("least_id"), F.col("vector").alias("point"))
        return rows.join(slices, "target").select("target", *named, mine, all_others).repartition(tasks, *block)

    queries = spread(cells.join(to_group, "cell"), "query", "candidate").groupBy(*block)
    candidates = spread(cells.join(to_groups, "cell").where(F.col("reach") >= F.col("least")), "candidate", "query").groupBy(*block)
    entry = pa.struct([("distance", pa.float64()), ("first", pa.int64()), ("other", pa.int64())])

    def best(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        asking, found, ends = [], [], [np.zeros(1, np.int64)]
        if queries.num_rows and candidates.num_rows:
            left, right = _matrix(queries, "point"), _matrix(candidates, "point")
            own, names, firsts = (t.column(c).to_numpy() for t, c in ((queries, "name"), (candidates, "name"), (candidates, "least_id")))
            squares = (right**2).sum(axis=1)
            # One product gives the squared distances but for the square of the query.
            factors = np.ascontiguousarray(np.c_[-2 * right, squares].T)
            take, sample = min(k + 1, len(right)), max(4096, 8 * (k + 1))
            step = max(1, DISTANCES // len(right))
            for at in range(0, len(left), step):
                rows = left[at : at + step]
                rough = np.c_[rows, np.ones(len(rows))] @ factors
                # The least of some bound the least of all. The short list is cut with room for rounding; the distances in it are computed plainly.
                bound = np.partition(rough[:, :sample], take - 1, axis=1)[:, take - 1]
                bound += 1e-9 * (1 + (rows**2).sum(axis=1) + squares.max())
                place, short = np.divmod(np.flatnonzero(rough <= bound[:, None]), len(right))
                other = names[short] != own[at + place]
                place, short = place[other], short[other]
                exact = np.concatenate(
                    [np.sqrt(((right[short[a : a + 65536]] - rows[place[a : a + 65536]]) ** 2).sum(axis=1)) for a in range(0, len(short), 65536)] or [np.empty(0)]
                )
                order = np.lexsort((names[short], firsts[short], exact, place))
                place, short, exact = place[order], short[order], exact[order]
                counts = np.bincount(place, minlength=len(rows))
                rank = np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts)
                kept = rank < k
                found.append((exact[kept], firsts[short[kept]], names[short[kept]]))
                asking.append(own[at : at + len(rows)])
                ends.append(np.minimum(counts, k))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)]
        lists = pa.ListArray.from_arrays(
            pa.array(np.cumsum(np.concatenate(ends)), pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(entry))
        )
        return pa.table({"number": pa.array(np.concatenate(asking) if asking else np.empty(0, np.int64)), "found": lists})

    proposed = queries.cogroup(candidates).applyInArrow(best, "number long, found array<struct<distance: double, first: long, other: long>>")
    # A list a block of candidates: k entries each.
    every = proposed.groupBy("number").agg(F.flatten(F.collect_list("found")).alias("found"))
    nearest = F.explode(F.slice(F.array_sort("found"), 1, k)).alias("entry")
    return every.select("number", nearest).select("number", "entry.other", "entry.distance")


def _blocks(rows: dict[int, int], arriving: dict[int, int], dimensions: int, cores: int) -> list[tuple[int, list[int], int, int]]:
    """``(group, targets, query parts, candidate parts)``: cells searched together, and the parts of both sides.

    Cells that need most rows need nearly the same ones, so they share them. There are several blocks for
    every core, and none holds more than the module's bounds.
    """
    most_queries = max(1, min(QUERY_ROWS, QUERY_VALUES // dimensions))
    most_candidates = max(1, min(CANDIDATE_ROWS, CANDIDATE_VALUES // dimensions))
    total = sum(rows.values())
    groups: list[list[int]] = []
    room = 0
    for target in sorted(rows):
        if 2 * arriving.get(target, 0) < total:
            groups.insert(0, [target])
        elif groups and rows[target] <= room:
            groups[-1].append(target)
            room -= rows[target]
        else:
            groups.append([target])
            room = most_queries - rows[target]
    sizes = [(sum(rows[t] for t in g), min(total, sum(arriving.get(t, 0) for t in g))) for g in groups]
    each = max(1, sum(own * others for own, others in sizes) // (4 * cores))
    blocks = []
    for group, (targets, (own, others)) in enumerate(zip(groups, sizes, strict=True)):
        query_parts = math.ceil(own / most_queries)
        candidates = min(most_candidates, max(2_000, each // math.ceil(own / query_parts)))
        blocks.append((group, targets, query_parts, max(1, math.ceil(others / candidates))))
    return blocks


def _routes(pivots: np.ndarray, facts: list, k: int) -> list[tuple[int, int, float]]:
    """``(cell, target, least)``: rows of ``cell`` this far from its pivot may be neighbours of rows of ``target``."""
    between = np.sqrt(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))
    routes = []
    for target in facts:
        # No row of the target cell is further from a row than radius + pivot to pivot + reach.
        bounds = sorted(target.radius + between[target.cell, cell.cell] + reach for cell in facts for reach in cell.inner)
        # The row itself is one of them.
        furthest = bounds[k] if len(bounds) > k else math.inf
        for cell in facts:
            least = between[target.cell, cell.cell] - target.radius - furthest
            least -= 1e-9 * (1 + between.max())
            if cell.radius >= least:
                routes.append((cell.cell, target.cell, float(least)))
    return routes
