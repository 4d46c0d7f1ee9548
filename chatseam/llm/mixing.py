"""Mixing sources to target weights.

Documents get hash-random keys; each source is sorted by key, and the words before a document are
a distributed prefix sum. A source gives its exact budget: whole epochs of all its documents, then
documents in key order, the last one cut where the budget ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatseam.llm.common import carried, random_key, restored, stored, table, with_sum_before, word_count
from chatseam.llm.registry import query

SEED = 42


def source_targets(sizes: DataFrame, weights: int = 3, most_epochs: int = 3) -> DataFrame:
    """Targets of sources (``_source``, ``_words``): weights 1, 2, ..., ``weights``, repeating by rank.

    All targets add up to all words. A source stops at ``most_epochs`` times its words; what it can't
    take is shared anew by weight. With sources sorted by words a unit of weight, those that stop
    are the first ones, so one running sum finds the level at which the others are filled. The
    table has one row a source; its two sorts are the only ones that aren't split.
    """
    by_name = Window.orderBy("_source")
    ranked = sizes.withColumn("_weight", (F.row_number().over(by_name) - 1) % weights + 1)
    room = F.col("_words") * most_epochs
    filling = Window.orderBy(F.col("_words") / F.col("_weight"), "_source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("_words").over(everything) - F.coalesce(F.sum(room).over(before), F.lit(0))) / F.sum("_weight").over(onward)
    return (
        ranked.withColumn("_level", level)
        .withColumn("_stops", room <= F.col("_level") * F.col("_weight"))
        .withColumn("_final", F.max(F.when(~F.col("_stops"), F.col("_level"))).over(everything))
        .withColumn(
            "_target",
            F.when(F.col("_stops") | F.col("_final").isNull(), room.cast("double"))
            .otherwise(F.col("_final") * F.col("_weight")),
        )
        .select("_source", F.col("_words").alias("_source_words"), "_target")
    )


def _sized(documents: DataFrame, seed: int) -> DataFrame:
    return documents.withColumns(
        {
            # A name that is never null and sorts like the source, nulls last.
            "_source": F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source")),
            "_size": word_count(F.col("text")),
            "_key": random_key(seed, "doc_id"),
        }
    )


def _with_taken(rows: DataFrame, weights: int, most_epochs: int) -> DataFrame:
    sizes = rows.groupBy("_source").agg(F.sum("_size").alias("_words"))
    placed = with_sum_before(rows, "_source", "_key", F.col("_size"), "_before", ("doc_id", "_size"))
    budget = F.round("_target").cast("bigint")
    words = F.greatest("_source_words", F.lit(1))
    epochs = F.floor(budget / words)
    rest = budget - epochs * words
    taken = epochs * F.col("_size") + F.greatest(F.lit(0), F.least("_size", rest - F.col("_before")))
    return placed.join(source_targets(sizes, weights, most_epochs), "_source").withColumn("_taken", taken.cast("bigint"))


def mix(documents: DataFrame, weights: int = 3, most_epochs: int = 3, seed: int = SEED) -> DataFrame:
    """How many words the mix takes of each document.

    Returns ``doc_id, source, size, source_size, target, taken``; one row for each input row.
    ``taken`` is ``size`` times the whole epochs of the source, plus what the last epoch takes.
    Null or empty text has no words and gives none. A null source is a source of its own, ranked
    last. Null ids share one key; repeated rows are taken like different ones (rows equal in id
    and size are interchangeable). An empty table gives an empty result. Other columns play no part.
    """
    rows = stored(_sized(documents.select("doc_id", "source", "text"), seed).select("doc_id", "source", "_source", "_size", "_key"))
    return _with_taken(rows, weights, most_epochs).select(
        "doc_id",
        "source",
        F.col("_size").alias("size"),
        F.col("_source_words").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_taken").alias("taken"),
    )


def mixed_documents(documents: DataFrame, weights: int = 3, most_epochs: int = 3, seed: int = SEED) -> DataFrame:
    """The mix itself: whole documents, each as often as its source's epochs reach it.

    A document that the budget cuts is given whole, so a source gives less than one document more
    than its target. Documents without words are not in a mix. Otherwise as ``mix``.
    """
    taken = _with_taken(_sized(carried(documents, "doc_id", "source"), seed), weights, most_epochs).where("_taken > 0")
    times = F.ceil(F.col("_taken") / F.col("_size")).cast("int")
    return taken.withColumn("_time", F.explode(F.sequence(F.lit(1), times))).select(*restored(documents.columns))


@query(
    "op1_mixing",
    r"""
    WITH sized AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             ('0x' || substr(md5('42:' || doc_id), 1, 15))::BIGINT AS k
      FROM documents),
    sources AS (SELECT source, sum(size)::BIGINT AS words FROM sized GROUP BY source),
    weighed AS (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight FROM sources),
    filled AS (
      SELECT *, ((SELECT sum(words) FROM sources)
                 - coalesce(sum(3 * words) OVER (ORDER BY words / weight, encode(source)
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY words / weight, encode(source)
                                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM weighed),
    targets AS (
      SELECT source, words, CASE WHEN 3 * words <= level * weight THEN (3 * words)::DOUBLE
             ELSE weight * max(CASE WHEN 3 * words > level * weight THEN level END) OVER () END AS target
      FROM filled),
    placed AS (
      SELECT s.*, t.words AS source_size, t.target, round(t.target)::BIGINT AS budget,
             (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size
                                ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS earlier
      FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, source, size, source_size, target,
           (budget // greatest(source_size, 1) * size
            + greatest(0, least(size, budget % greatest(source_size, 1) - earlier)))::BIGINT AS taken
    FROM placed
    """,
)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
