"""Cleaning, identifiers, keep-first deduplication, language fill and the canonical projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatseam.functions.languages import detect_language, needs_detection
from chatseam.functions.once import with_computed
from chatseam.functions.text import clean_text, is_blank, md5_prefix, strip
from chatseam.operators.normalize import POSITION
from chatseam.schema import CANONICAL_COLUMNS
from chatseam.specs import CANONICAL_FIELDS, CorpusSpec, IngestSettings


def drop_blank_bodies(messages: DataFrame, body: str = "body") -> DataFrame:
    return messages.where(F.col(body).isNotNull() & ~is_blank(F.col(body)))


def drop_short_bodies(messages: DataFrame, min_length: int, body: str = "body") -> DataFrame:
    """Keep bodies of at least ``min_length`` code points."""
    return messages.where(F.length(body) >= min_length)


def clean_bodies(messages: DataFrame, min_length: int = 5, body: str = "body") -> DataFrame:
    """Both filters and the cleaning in one step that touches each text once.

    A text is blank exactly if nothing is left after cleaning.
    """
    return with_computed(
        messages,
        {body: clean_text(F.col(body))},
        keep=lambda row: (row[body] != "") & (F.length(row[body]) >= min_length),
    )


def message_id(dataset: str | Column, file: Column, ordinal: Column, existing: Column) -> Column:
    """The stripped source id, or a hash of dataset, file and place in the file."""
    dataset = F.lit(dataset) if isinstance(dataset, str) else dataset
    own = strip(existing)
    generated = md5_prefix(F.concat_ws("::", dataset, file, ordinal.cast("string")))
    return F.when(own != "", own).otherwise(generated)


def keep_first(
    rows: DataFrame, key: Sequence[str | Column], order: Sequence[str | Column]
) -> DataFrame:
    """One row per key, the first by ``order``; rows whose key is null all stay.

    Ranking by ``row_number() = 1`` lets every map task keep one row per key
    before the shuffle, so copies of a hot key are not sent to one reducer.
    """
    key = [F.col(part) if isinstance(part, str) else part for part in key]
    order = [F.col(part) if isinstance(part, str) else part for part in order]
    no_key = F.lit(False)
    for part in key:
        no_key = no_key | part.isNull()
    # A null key is replaced by the row's own position: no group, no hot spot.
    window = Window.partitionBy(*key, F.when(no_key, F.struct(*order))).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def clean(
    normalized: DataFrame, spec: CorpusSpec, settings: IngestSettings = IngestSettings()
) -> DataFrame:
    """Drop blank and short bodies, clean the text, make ids, keep the first of each key.

    Ids are made before deduplication, so records without one are not lumped together.
    """
    cleaned = clean_bodies(normalized, settings.min_body_length).withColumn(
        "message_id", message_id(spec.name, F.col("record_file"), F.col("ordinal"), F.col("msg_id"))
    )
    if settings.dedup_column is None:
        return cleaned
    return keep_first(cleaned, [_dedup_key(settings.dedup_column)], POSITION)


def _dedup_key(column: str) -> Column:
    if column in ("msg_id", "message_id"):
        return F.col("message_id")
    if column in (*CANONICAL_FIELDS, "source_file", "language"):
        return F.col(column)
    return F.try_variant_get(F.element_at("extras", F.lit(column)), "$", "string")


def fill_language(messages: DataFrame, text: str = "body", language: str = "language") -> DataFrame:
    """Detect the language where it is null or ``unknown``; keep it elsewhere."""
    known = F.col(language) if language in messages.columns else F.lit(None).cast("string")
    filled = F.when(needs_detection(known), detect_language(F.col(text))).otherwise(known)
    return with_computed(messages, {language: filled})


def metadata_json() -> Column:
    """Recipient and extras as one JSON object."""
    recipient = F.when(
        F.col("recipient").isNotNull(),
        F.create_map(F.lit("recipient"), F.col("recipient").cast("variant")),
    ).otherwise(F.create_map().cast("map<string,variant>"))
    return F.to_json(F.map_concat(recipient, F.col("extras")))


def to_canonical(messages: DataFrame, dataset: str) -> DataFrame:
    """The eight canonical columns in their fixed order."""
    return messages.select(
        F.col("message_id"),
        F.lower(strip(F.lit(dataset))).alias("dataset"),
        F.col("sender").alias("actor"),
        F.col("timestamp"),
        F.coalesce("language", F.lit("unknown")).alias("language"),
        F.col("body").alias("raw_text"),
        F.coalesce("source_file", F.lit("unknown")).alias("source_file"),
        metadata_json().alias("metadata"),
    ).select(*CANONICAL_COLUMNS)


def drop_copied_rows(rows: DataFrame) -> DataFrame:
    """Full-row distinct; each map task drops its own copies before the shuffle."""
    return rows.dropDuplicates()


def exploration_dedup(rows: DataFrame, position: Sequence[str]) -> DataFrame:
    """Keep the first row per ``msg_id``; if no row has an id, drop full copies instead.

    Which of the two applies is a one-value subquery, so the plan needs no
    intermediate job. Among rows with ids, those without one are all kept.
    """
    any_id = rows.select(F.coalesce(F.bool_or(F.col("msg_id").isNotNull()), F.lit(False))).scalar()
    content = [name for name in rows.columns if name not in position]
    # 256 bits stand for the row, so that rows are not shuffled and sorted by all they hold.
    as_text = F.struct(*[F.col(f"`{name}`").cast("string").alias(name) for name in content])
    whole_row = F.sha2(F.to_json(as_text, {"ignoreNullFields": "false"}), 256)
    own_place = F.struct(*position)
    keyed = (
        rows.withColumn("_by_id", F.when(any_id, F.col("msg_id")))
        .withColumn("_by_place", F.when(any_id & F.col("msg_id").isNull(), own_place))
        .withColumn("_by_row", F.when(~any_id, whole_row))
    )
    window = Window.partitionBy("_by_id", "_by_place", "_by_row").orderBy(*position)
    return (
        keyed.withColumn("_rank", F.row_number().over(window))
        .where("_rank = 1")
        .drop("_rank", "_by_id", "_by_place", "_by_row")
    )


def subset(messages: DataFrame, language: str, min_length: int = 20, text: str = "raw_text") -> DataFrame:
    """Messages of one language with at least ``min_length`` code points."""
    return messages.where((F.col("language") == language) & (F.length(text) >= min_length))


def flag_date_range(messages: DataFrame, bounds: tuple[str, str] | None, only: bool = False) -> DataFrame:
    """Add ``in_range``: both days inclusive, null without a timestamp or without bounds."""
    day = F.col("timestamp").cast("date")
    inside = F.lit(None).cast("boolean") if bounds is None else day.between(
        F.lit(bounds[0]).cast("date"), F.lit(bounds[1]).cast("date")
    )
    flagged = messages.withColumn("in_range", inside)
    return flagged.where("in_range") if only else flagged


def flag_expected_language(messages: DataFrame, languages: Sequence[str]) -> DataFrame:
    return messages.withColumn("expected_language", F.col("language").isin(*languages))
