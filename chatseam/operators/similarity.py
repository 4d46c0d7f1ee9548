"""Embeddings: encoding, reduction, clustering and nearest targets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatseam.functions.text import tokens

SIMILARITY_THRESHOLD = 0.65
CANDIDATES = 3
CONFIDENCE_THRESHOLD = 0.7

# Targets held by one task at a time, as values of 8 bytes: 64 MB.
MAX_TARGET_VALUES = 8_000_000


def hashed_tfidf(
    documents: DataFrame,
    text: str = "raw_text",
    dimensions: int = 1024,
    stop_words: Iterable[str] = (),
) -> DataFrame:
    """Add ``features``, a unit-length hashed TF-IDF vector.

    A substitute for sentence embeddings that needs no model. Fitting the
    document frequencies runs one job.
    """
    parsed = documents.withColumn("_tokens", tokens(F.col(text), stop_words))
    pipeline = Pipeline(
        stages=[
            HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dimensions),
            IDF(inputCol="_tf", outputCol="_tfidf"),
            Normalizer(inputCol="_tfidf", outputCol="features"),
        ]
    )
    return pipeline.fit(parsed).transform(parsed).drop("_tokens", "_tf", "_tfidf")


def embed(documents: DataFrame, encoder: Callable[[Column], Column], text: str = "raw_text") -> DataFrame:
    """Add ``embedding`` from a user's encoder, typically a ``pandas_udf`` over Arrow batches."""
    return documents.withColumn("embedding", encoder(F.col(text)))


def reduce_dimensions(vectors: DataFrame, vector: str = "embedding", k: int = 5) -> DataFrame:
    """Add ``reduced``, the first ``k`` principal components.

    A linear substitute for a neighbourhood-preserving projection.
    """
    prepared = vectors.withColumn("_features", array_to_vector(vector))
    model = PCA(k=k, inputCol="_features", outputCol="_reduced").fit(prepared)
    return model.transform(prepared).withColumn("reduced", vector_to_array("_reduced")).drop("_features", "_reduced")


def cluster(
    vectors: DataFrame,
    vector: str = "embedding",
    k: int = 10,
    min_cluster_size: int = 30,
    seed: int = 42,
) -> DataFrame:
    """Add ``topic``: k-means clusters, those under ``min_cluster_size`` lumped as outliers (-1).

    Not density based: a substitute with the same outlier convention.
    """
    prepared = vectors.withColumn("_features", array_to_vector(vector))
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="_cluster").fit(prepared)
    assigned = model.transform(prepared).drop("_features")
    # At most k rows, so the broadcast is bounded by a parameter.
    sizes = assigned.groupBy("_cluster").agg(F.count(F.lit(1)).alias("_size"))
    topic = F.when(F.col("_size") >= min_cluster_size, F.col("_cluster")).otherwise(F.lit(-1))
    return assigned.join(F.broadcast(sizes), "_cluster").withColumn("topic", topic).drop("_cluster", "_size")


def centroids(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per group; positions are averaged map-side, so a hot group is no burden."""
    values = vectors.select(group, F.posexplode(vector).alias("_pos", "_value"))
    means = values.groupBy(group, "_pos").agg(F.avg(F.col("_value").cast("double")).alias("_mean"))
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_mean")))
    return means.groupBy(group).agg(F.transform(ordered, lambda cell: cell["_mean"]).alias(vector))


def _best_in_block(
    vectors: DataFrame, block: DataFrame, key: str, target: str, vector: str, threshold: float, k: int
) -> DataFrame:
    # Defined here so that it travels by value: workers need not be able to import this package.
    def unit_rows(matrix: np.ndarray) -> np.ndarray:
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)

    rows = sorted(block.select(target, vector).collect())
    ids = np.array([row[0] for row in rows])
    matrix = unit_rows(np.array([row[1] for row in rows], dtype=np.float64)) if rows else None
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))
    key_type = vectors.schema[key].dataType.simpleString()
    target_type = block.schema[target].dataType.simpleString()

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        # Scores of a slice of rows against all targets: 64 MB at most, whatever the number of targets.
        step = max(1, 2**23 // max(1, len(ids)))
        slices = (batch.iloc[at : at + step] for batch in batches for at in range(0, len(batch), step))
        for batch in slices:
            if matrix is None:
                continue
            scores = unit_rows(np.vstack(batch[vector].to_numpy()).astype(np.float64)) @ matrix.T
            # Targets are sorted by id, so a stable sort breaks ties by id.
            best = np.argsort(-np.round(scores, 12), axis=1, kind="stable")[:, :k]
            kept = np.take_along_axis(scores, best, axis=1)
            row, place = np.nonzero(kept >= threshold)
            yield pd.DataFrame(
                {
                    key: batch[key].to_numpy()[row],
                    target: ids[best[row, place]],
                    "score": kept[row, place],
                }
            )

    present = vectors.where(F.col(vector).isNotNull()).select(key, vector)
    return present.mapInPandas(match, f"{key} {key_type}, {target} {target_type}, score double")


def nearest_targets(
    vectors: DataFrame,
    targets: DataFrame,
    key: str,
    target: str,
    vector: str = "embedding",
    threshold: float = SIMILARITY_THRESHOLD,
    k: int = CANDIDATES,
) -> DataFrame:
    """``(key, target, score, rank)``: up to ``k`` targets per vector with enough cosine similarity.

    The targets (technique descriptions, centroids) are few. They are counted
    first; one block is shared with all tasks, and a set too large for one is
    worked off in several, whose results are ranked together. Matrix products
    over Arrow batches beat element-wise expressions by orders of magnitude
    here, which is why this leaves the JVM.
    """
    size = targets.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    blocks = max(1, math.ceil(size[0] * (size[1] or 1) / MAX_TARGET_VALUES))
    parts = [
        _best_in_block(
            vectors,
            targets if blocks == 1 else targets.where(F.pmod(F.xxhash64(target), F.lit(blocks)) == part),
            key,
            target,
            vector,
            threshold,
            k,
        )
        for part in range(blocks)
    ]
    matches = parts[0]
    for part in parts[1:]:
        matches = matches.unionByName(part)
    window = Window.partitionBy(key).orderBy(F.round("score", 12).desc(), target)
    return matches.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def filter_confident(entities: DataFrame, threshold: float = CONFIDENCE_THRESHOLD, score: str = "score") -> DataFrame:
    return entities.where(F.col(score) >= threshold)
