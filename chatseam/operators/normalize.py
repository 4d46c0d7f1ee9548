"""Raw records to canonical fields.

Names are resolved per record, never per table: a record's canonical field is
the first non-null value among the canonical name and its aliases. What is not
consumed stays in ``extras``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatseam.functions.once import with_computed
from chatseam.functions.timestamps import MILLISECOND_THRESHOLD, from_epoch, parse_text_timestamp, parse_timestamp
from chatseam.specs import CANONICAL_FIELDS, CorpusSpec

POSITION = ("format_rank", "record_file", "ordinal")
RESERVED = (*CANONICAL_FIELDS, "language", "source_file", "_source_file")

# Records of one file that meet its facts under one key: a large file is many keys.
STRETCH = 100_000


def field_value(name: str) -> Column:
    return F.element_at("rec", F.lit(name))


def field_text(name: str) -> Column:
    """A field as text: null for absent or JSON null, JSON text for lists and objects."""
    return F.try_variant_get(field_value(name), "$", "string")


def _names(canonical: str, spec: CorpusSpec) -> list[str]:
    """The canonical name, then its aliases, without repeats."""
    return list(dict.fromkeys((canonical, *spec.column_aliases.get(canonical, ()))))


def _pick(names: Sequence[str]) -> Column:
    """``(name, value)`` of the first field among the names that holds a value."""
    candidates = ", ".join(
        f"struct({name} AS name, try_variant_get(element_at(rec, {name}), '$', 'string') AS value)"
        for name in map(_sql_text, names)
    )
    return F.expr(f"get(filter(array({candidates}), c -> c.value IS NOT NULL), 0)")


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _first_text(names: Sequence[str]) -> Column:
    return F.coalesce(*[field_text(name) for name in names])


def _body_names(spec: CorpusSpec) -> list[str]:
    """Where a body may come from: its own name, promoted fields, then the other aliases."""
    return list(dict.fromkeys(("body", *spec.promote_body, *_names("body", spec))))


def nested_text(content: Column) -> Column:
    """``content.body`` of an object, a string itself, null for anything else."""
    is_string = F.schema_of_variant(content) == "STRING"
    return F.coalesce(
        F.try_variant_get(content, "$.body", "string"),
        F.when(is_string, F.try_variant_get(content, "$", "string")),
    )


def _file_number(time_text: Column) -> Column:
    number = F.trim(time_text).try_cast("double")
    return F.when(~F.isnan(number), number)


def _stretch() -> Column:
    return F.coalesce(F.floor(F.col("ordinal") / STRETCH), F.lit(0)).alias("_stretch")


def _file_facts(records: DataFrame, spec: CorpusSpec) -> DataFrame:
    """Per file: does it have ``type`` at all, and is its median numeric time in milliseconds.

    Whether a median lies above a threshold follows from how many values lie on
    either side of it, plus the two values next to it when the sides are equal.
    So the facts combine map-side, whatever the size of a file. Each stretch of
    a file gets a row of its own with the facts of the whole file.
    """
    number = F.col("_number")
    typed = F.col("_is_event") if spec.event_type else F.lit(True)
    above, below = number > MILLISECOND_THRESHOLD, number <= MILLISECOND_THRESHOLD

    def median_inputs(rows: Column) -> Column:
        return F.struct(
            F.count_if(rows & above).alias("above"),
            F.count_if(rows & below).alias("below"),
            F.max(F.when(rows & below, number)).alias("nearest_below"),
            F.min(F.when(rows & above, number)).alias("nearest_above"),
        )

    facts = (
        records.select(
            "record_file",
            _stretch(),
            _file_number(_first_text(_names("timestamp", spec))).alias("_number"),
            F.map_contains_key("rec", F.lit("type")).alias("_has_type"),
            F.coalesce(field_text("type") == (spec.event_type or ""), F.lit(False)).alias("_is_event"),
        )
        .groupBy("record_file", "_stretch")
        .agg(
            F.bool_or("_has_type").alias("_has_type"),
            median_inputs(F.lit(True)).alias("_all"),
            median_inputs(typed).alias("_typed"),
        )
    )
    file = Window.partitionBy("record_file")

    def whole_file(part: str) -> Column:
        return F.struct(
            F.sum(f"{part}.above").over(file).alias("above"),
            F.sum(f"{part}.below").over(file).alias("below"),
            F.max(f"{part}.nearest_below").over(file).alias("nearest_below"),
            F.min(f"{part}.nearest_above").over(file).alias("nearest_above"),
        )

    has_type = F.bool_or("_has_type").over(file)
    facts = facts.select(
        "record_file", "_stretch", has_type.alias("_file_has_type"), whole_file("_all").alias("_all"), whole_file("_typed").alias("_typed")
    )
    inputs = F.when(F.col("_file_has_type"), F.col("_typed")).otherwise(F.col("_all"))
    return facts.select("record_file", "_stretch", "_file_has_type", inputs.alias("_m")).select(
        "record_file",
        "_stretch",
        "_file_has_type",
        (F.col("_m.above") + F.col("_m.below") > 0).alias("_file_numeric"),
        F.when(
            F.col("_m.above") == F.col("_m.below"),
            (F.col("_m.nearest_below") + F.col("_m.nearest_above")) / 2 > MILLISECOND_THRESHOLD,
        )
        .otherwise(F.col("_m.above") > F.col("_m.below"))
        .alias("_file_millis"),
    )


def _extras(consumed: Column, spec: CorpusSpec) -> Column:
    """Unconsumed non-null fields, and the prefixed copies of the passthrough fields."""
    copies = [(name, f"{spec.passthrough_prefix}{name}") for name in spec.passthrough]

    def is_extra(name: Column, value: Column) -> Column:
        keep = value.isNotNull() & ~F.is_variant_null(value) & ~name.isin(*RESERVED)
        keep = keep & ~F.coalesce(F.array_contains(consumed, name), F.lit(False))
        for source, copy in copies:
            keep = keep & ~((name == copy) & field_text(source).isNotNull())
        return keep

    extras = F.map_filter("rec", is_extra)
    if not copies:
        return extras
    copied = F.map_filter(
        F.map_from_arrays(
            F.array(*[F.lit(copy) for _, copy in copies]), F.array(*[field_value(source) for source, _ in copies])
        ),
        lambda _, value: value.isNotNull() & ~F.is_variant_null(value),
    )
    return F.map_concat(copied, extras)


def flag_events(records: DataFrame, spec: CorpusSpec) -> DataFrame:
    """Add the per-file facts the spec needs and ``_kept``, the event filter's verdict.

    Records meet the facts by file and stretch of the file, so a large file is no
    hot key. Corpora without per-file rules need no facts and stay one narrow stage.
    """
    kept = F.lit(True)
    if spec.event_type is not None or spec.epoch_rule == "file_median":
        facts = _file_facts(records, spec)
        records = records.withColumn("_stretch", _stretch()).join(facts, ["record_file", "_stretch"]).drop("_stretch")
    if spec.event_type is not None:
        is_event = F.coalesce(field_text("type") == spec.event_type, F.lit(False))
        kept = ~F.col("_file_has_type") | is_event
    if spec.msgtypes is not None:
        msgtype = F.try_variant_get(field_value(spec.nested_body or "content"), "$.msgtype", "string")
        kept = kept & F.coalesce(msgtype.isin(*spec.msgtypes), F.lit(False))
    return records.withColumn("_kept", kept)


def normalize(records: DataFrame, spec: CorpusSpec) -> DataFrame:
    """Canonical fields of every raw record that passes the corpus's event filter."""
    records = flag_events(records, spec).where("_kept")
    picked = with_computed(
        records,
        {
            **{f"_{name}": _pick(_names(name, spec)) for name in CANONICAL_FIELDS if name != "body"},
            "_body": _pick(_body_names(spec)),
        },
    )
    time_text = F.col("_timestamp.value")
    if spec.epoch_rule == "file_median":
        timestamp = F.when(
            F.col("_file_numeric"), from_epoch(_file_number(time_text), F.col("_file_millis"))
        ).otherwise(parse_text_timestamp(time_text))
    else:
        timestamp = parse_timestamp(time_text)

    body, body_field = F.col("_body.value"), F.col("_body.name")
    if spec.promote_body:
        body_field = F.when(~body_field.isin(*spec.promote_body), body_field)
    if spec.nested_body is not None:
        has_nested = F.map_contains_key("rec", F.lit(spec.nested_body))
        body = F.when(has_nested, nested_text(field_value(spec.nested_body))).otherwise(body)
        body_field = F.when(~has_nested, body_field)
    consumed = F.array(
        *[F.col(f"_{name}.name") for name in CANONICAL_FIELDS if name != "body"], body_field
    )
    normalized = picked.select(
        *POSITION,
        F.coalesce(field_text("source_file"), F.col("source_file"), F.lit("unknown")).alias("source_file"),
        F.col("_msg_id.value").alias("msg_id"),
        timestamp.alias("timestamp"),
        F.col("_sender.value").alias("sender"),
        F.col("_recipient.value").alias("recipient"),
        body.alias("body"),
        field_text("language").alias("language"),
        _extras(consumed, spec).alias("extras"),
    )
    return normalized.transform(spec.transform) if spec.transform else normalized


def exploration_projection(normalized: DataFrame) -> DataFrame:
    """Only the canonical fields and the source file."""
    return normalized.select(*CANONICAL_FIELDS, "source_file")
