"""BM25 ranking and its fusion with vector scores."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatseam.functions.once import with_computed
from chatseam.functions.text import tokens
from chatseam.functions.vectors import cosine

K1 = 1.5
B = 0.75
TOP_K = 10
VECTOR_WEIGHT = 0.7


def query_terms(text: str) -> list[str]:
    """The terms of a query, cut as :func:`chatseam.functions.text.tokens` cuts documents."""
    return re.findall(r"\w{2,}", text.lower())


def bm25_scores(
    documents: DataFrame,
    queries: Mapping[str, str],
    key: str = "message_id",
    text: str = "raw_text",
    k1: float = K1,
    b: float = B,
) -> DataFrame:
    """``(query, key, score)`` for every document that shares a term with a query.

    Queries are few and known to the caller, so their terms are constants in
    the plan: one scan counts documents, lengths and document frequencies, a
    second scores each document within its row. Neither shuffles the corpus.
    """
    wanted = {name: query_terms(query) for name, query in queries.items()}
    vocabulary = sorted({term for found in wanted.values() for term in found})
    if not vocabulary:
        raise ValueError("no query has a term to search for")
    parsed = with_computed(documents.select(key, text), {"_tokens": tokens(F.col(text))}).drop(text)
    facts = parsed.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.size("_tokens")).alias("mean_length"),
        F.array(*[F.count_if(F.array_contains("_tokens", term)) for term in vocabulary]).alias("df"),
    ).select(F.struct("*").alias("facts"))
    matching = with_computed(
        parsed.withColumn("_length", F.size("_tokens")),
        {"_hits": F.filter("_tokens", lambda token: token.isin(vocabulary))},
        keep=lambda row: F.size(row["_hits"]) > 0,
    )
    scored = matching.select(key, "_length", "_hits", facts.scalar().alias("_facts"))
    length_norm = k1 * (1 - b + b * F.col("_length") / F.col("_facts.mean_length"))

    def term_score(term: str) -> Column:
        df = F.col("_facts.df")[vocabulary.index(term)]
        idf = F.log(1 + (F.col("_facts.n") - df + 0.5) / (df + 0.5))
        tf = F.size(F.filter("_hits", lambda token: token == term))
        return idf * tf * (k1 + 1) / (tf + length_norm)

    per_term = scored.select(key, F.array(*[term_score(term) for term in vocabulary]).alias("_score"))

    def query_score(found: Sequence[str]) -> Column:
        total = F.lit(0.0)
        for term in found:
            total = total + F.col("_score")[vocabulary.index(term)]
        return total

    results = F.array(
        *[
            F.struct(F.lit(name).alias("query"), query_score(found).alias("score"))
            for name, found in wanted.items()
            if found
        ]
    )
    return per_term.select(key, F.inline(results)).where("score > 0").select("query", key, "score")


def top_per_query(scores: DataFrame, key: str, k: int = TOP_K) -> DataFrame:
    """The ``k`` best per query with their ``rank``; ties go to the smaller key."""
    window = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), key)
    return scores.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def bm25_search(documents: DataFrame, queries: Mapping[str, str], k: int = TOP_K, **columns: str) -> DataFrame:
    return top_per_query(bm25_scores(documents, queries, **columns), columns.get("key", "message_id"), k)


def vector_scores(vectors: DataFrame, query_vector: Column, key: str, vector: str) -> DataFrame:
    """``(key, score)``: cosine similarity of every vector to one query vector."""
    paired = vectors.select(key, vector, query_vector.alias("_query"))
    return paired.select(key, cosine(F.col(vector), F.col("_query")).alias("score"))


def _min_max(scores: DataFrame, key: str, name: str) -> DataFrame:
    ends = scores.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    ends = ends.select(F.struct("*").alias("ends")).scalar()
    scaled = scores.select(key, "score", ends.alias("_e"))
    spread = F.col("_e.high") - F.col("_e.low")
    value = F.when(spread > 0, (F.col("score") - F.col("_e.low")) / spread).otherwise(F.lit(1.0))
    return scaled.select(key, value.alias(name))


def hybrid_search(
    text_scores: DataFrame,
    vector_scores: DataFrame,
    key: str = "message_id",
    vector_weight: float = VECTOR_WEIGHT,
    k: int = TOP_K,
) -> DataFrame:
    """Fuse two score lists ``(key, score)`` of one query and return the ``k`` best.

    Both are scaled to 0..1; a document missing from a list scores 0 there. All
    scored documents take part, none are cut before the fusion.
    """
    by_text = _min_max(text_scores, key, "text_score")
    by_vector = _min_max(vector_scores, key, "vector_score")
    joined = by_text.join(by_vector, key, "full_outer")
    text, vector = (F.coalesce(name, F.lit(0.0)) for name in ("text_score", "vector_score"))
    fused = joined.select(
        key,
        text.alias("text_score"),
        vector.alias("vector_score"),
        (vector * vector_weight + text * (1 - vector_weight)).alias("score"),
    )
    return fused.orderBy(F.round("score", 9).desc(), key).limit(k)
