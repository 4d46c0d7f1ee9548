"""The canonical message table: column order, types and row validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatseam.functions.text import is_blank

CANONICAL_SCHEMA = T.StructType(
    [
        T.StructField("message_id", T.StringType(), False),
        T.StructField("dataset", T.StringType(), False),
        T.StructField("actor", T.StringType(), True),
        T.StructField("timestamp", T.TimestampType(), True),
        T.StructField("language", T.StringType(), False),
        T.StructField("raw_text", T.StringType(), False),
        T.StructField("source_file", T.StringType(), False),
        T.StructField("metadata", T.StringType(), False),
    ]
)
CANONICAL_COLUMNS = CANONICAL_SCHEMA.fieldNames()

REQUIRED_TEXT = ("message_id", "raw_text", "dataset")


def validation_errors() -> Column:
    """Array of messages, one per required field that is null or blank; empty for a good row."""
    return F.array_compact(
        F.array(
            *[
                F.when(F.col(name).isNull() | is_blank(F.col(name)), F.lit(f"{name} must not be empty"))
                for name in REQUIRED_TEXT
            ]
        )
    )


def with_validation(messages: DataFrame) -> DataFrame:
    """Add ``errors``; one column serves both the valid and the rejected split."""
    return messages.withColumn("errors", validation_errors())


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") == 0).drop("errors")


def rejected_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") > 0)


def decode_metadata(messages: DataFrame, strict: bool = False) -> DataFrame:
    """Turn the JSON ``metadata`` into a VARIANT; null becomes ``{}``.

    Text that is not JSON also becomes ``{}`` unless ``strict``, in which case
    the query fails when it reaches such a row.
    """
    parse = F.parse_json if strict else F.try_parse_json
    empty = F.parse_json(F.lit("{}"))
    return messages.withColumn("metadata", F.coalesce(parse(F.col("metadata")), empty))
