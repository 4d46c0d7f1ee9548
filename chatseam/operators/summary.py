"""Run summaries and the corpus catalog."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatseam.specs import CorpusSpec, registered_names

def drop_rate(written: Column, raw: Column) -> Column:
    return F.when(raw > 0, F.round(1 - written / raw, 4)).otherwise(F.lit(0.0))


def run_summary(dataset: str, flagged: DataFrame, checked: DataFrame) -> DataFrame:
    """One row of stage counts.

    ``flagged`` are the raw records with ``_kept``; ``checked`` the cleaned rows
    with ``errors`` and ``language``. Each is aggregated once, and only the
    per-language counts meet in one task.
    """
    raw = flagged.agg(
        F.count(F.lit(1)).alias("records_raw"), F.count_if("_kept").alias("records_after_normalize")
    ).select(F.struct("*").alias("raw"))
    per_language = checked.groupBy("language").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("errors") == 0).alias("valid")
    )
    clean = per_language.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records_after_clean"),
        F.coalesce(F.sum("valid"), F.lit(0)).alias("records_written"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("language_distribution"),
    ).withColumn("raw", raw.scalar())
    return clean.select(
        F.lit(dataset).alias("dataset"),
        "raw.records_raw",
        "raw.records_after_normalize",
        "records_after_clean",
        "records_written",
        drop_rate(F.col("records_written"), F.col("raw.records_raw")).alias("drop_rate"),
        "language_distribution",
    )


def catalog(spark: SparkSession, specs: Mapping[str, CorpusSpec]) -> DataFrame:
    """``name, enabled, display_name`` of every known corpus, by name.

    A built-in corpus without a configuration entry is listed as disabled.
    """
    rows = [
        (name, specs[name].enabled, specs[name].display_name) if name in specs else (name, False, name)
        for name in registered_names(specs)
    ]
    return spark.createDataFrame(rows, "name string, enabled boolean, display_name string").orderBy("name")


def catalog_counts(messages: DataFrame, specs: Mapping[str, CorpusSpec]) -> DataFrame:
    """The catalog with the number of messages held per corpus."""
    held = messages.groupBy(F.col("dataset").alias("name")).agg(F.count(F.lit(1)).alias("messages"))
    listed = catalog(messages.sparkSession, specs)
    return (
        listed.join(held, "name", "left")
        .select("name", "enabled", "display_name", F.coalesce("messages", F.lit(0)).alias("messages"))
        .orderBy("name")
    )
