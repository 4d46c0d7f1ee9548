"""The given tables as raw records and as messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatseam.session import prepare, spread
from chatseam.specs import CorpusSpec

CONVERSATIONS = CorpusSpec(
    name="conversations",
    display_name="Assistant conversations",
    column_aliases={
        "msg_id": ("id", "message_id"),
        "timestamp": ("date", "ts"),
        "sender": ("from", "author"),
        "recipient": ("to", "room"),
        "body": ("text", "message", "msg"),
    },
)

DOCUMENTS = CorpusSpec(
    name="documents",
    display_name="Documents as tickets",
    column_aliases={
        "msg_id": ("id", "ticket_id"),
        "sender": ("source",),
        "body": ("message", "text", "description"),
    },
    promote_body=("message", "description"),
    passthrough=("status", "priority"),
    passthrough_prefix="lk_",
)

EVENTS = CorpusSpec(
    name="events",
    display_name="Event export",
    column_aliases={
        "msg_id": ("event_id",),
        "timestamp": ("origin_server_ts",),
        "sender": ("user_id",),
        "recipient": ("room_id",),
        "body": ("content",),
    },
    event_type="view",
    nested_body="content",
    epoch_rule="file_median",
)

SPECS = {spec.name: spec for spec in (CONVERSATIONS, DOCUMENTS, EVENTS)}


# Tables whose rows are costly enough to be worth spreading when the file is small.
_COSTLY_TABLES = ("documents", "conversations", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    data = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(data) if name in _COSTLY_TABLES else data


def _record(fields: dict[str, Column]) -> Column:
    """A raw record of the non-null fields."""
    pairs = [part for name, value in fields.items() for part in (F.lit(name), value.cast("variant"))]
    return F.map_filter(F.create_map(*pairs), lambda _, value: value.isNotNull())


def _raw(rows: DataFrame, file: Column, ordinal: Column, fields: dict[str, Column]) -> DataFrame:
    return rows.select(
        file.alias("source_file"),
        file.alias("record_file"),
        F.lit(0).alias("format_rank"),
        ordinal.cast("bigint").alias("ordinal"),
        _record(fields).alias("rec"),
    )


def conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chat records: odd turns name their body ``msg``, first turns have no id."""
    turns = table(spark, sf_dir, "conversations")
    odd = F.col("turn") % 2 == 1
    return _raw(
        turns,
        F.lit("conversations.json"),
        F.shiftleft("conv_id", 20) + F.col("turn"),
        {
            "id": F.when(F.col("turn") > 0, F.concat_ws("-", "conv_id", "turn")),
            "from": F.col("role"),
            "to": F.col("conv_id"),
            "text": F.when(~odd, F.col("text")),
            "msg": F.when(odd, F.col("text")),
            "turn": F.col("turn"),
        },
    )


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tickets whose body sits in one of three fields."""
    documents = table(spark, sf_dir, "documents")
    place = F.col("doc_id") % 3
    return _raw(
        documents,
        F.lit("documents.json"),
        F.col("doc_id"),
        {
            "id": F.col("doc_id"),
            "source": F.col("source"),
            "message": F.when(place == 0, F.col("text")),
            "description": F.when(place == 1, F.col("text")),
            "body": F.when(place == 2, F.col("text")),
            "status": F.col("lang"),
            "priority": F.col("n_chars"),
            "language": F.when(place != 0, F.col("lang")),
        },
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as four export files: file 2 has no ``type``, file 3 counts seconds, the rest milliseconds."""
    events = table(spark, sf_dir, "events")
    file = F.col("event_id") % 4
    ts = F.col("ts").cast("timestamp")
    body = F.concat_ws(" ", "event_type", "props")
    content = F.to_variant_object(F.struct(F.lit("m.text").alias("msgtype"), body.alias("body")))
    return _raw(
        events,
        F.concat(F.lit("events_"), file, F.lit(".json")),
        F.col("event_id"),
        {
            "event_id": F.col("event_id"),
            "type": F.when(file != 2, F.col("event_type")),
            "origin_server_ts": F.when(file == 3, F.unix_seconds(ts)).otherwise(F.unix_millis(ts)),
            "user_id": F.col("user_id"),
            "room_id": F.get_json_object("props", "$.k"),
            "content": content,
            "value": F.col("value"),
        },
    )


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under canonical names, for the text operators."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id"),
        F.col("doc_id").cast("string").alias("message_id"),
        F.col("source").alias("actor"),
        F.col("lang").alias("language"),
        F.col("text").alias("raw_text"),
    )


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under canonical names, for the time and graph operators."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("message_id"),
        F.col("user_id").alias("actor"),
        F.get_json_object("props", "$.k").cast("bigint").alias("recipient"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_type"),
        F.col("event_type").alias("raw_text"),
        F.col("value"),
        F.col("props").alias("metadata"),
    )
