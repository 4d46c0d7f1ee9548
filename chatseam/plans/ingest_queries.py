"""Queries for projections, filters, scalar functions, deduplication and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatseam.functions.languages import needs_detection
from chatseam.functions.once import with_computed
from chatseam.functions.text import chunks, clean_text, md5_prefix
from chatseam.functions.timestamps import parse_timestamp
from chatseam.functions.vectors import l2_norm, l2_normalize
from chatseam.operators import clean as C
from chatseam.operators.normalize import exploration_projection, flag_events, normalize
from chatseam.operators.sampling import capped_sample
from chatseam.operators.summary import run_summary
from chatseam.plans import sql
from chatseam.plans import tables as T
from chatseam.plans.ingest import canonical_messages
from chatseam.plans.registry import query
from chatseam.schema import decode_metadata, rejected_rows, valid_rows, with_validation
from chatseam.sources.ranges import cut_records
from chatseam.specs import DEFAULT_ENVELOPE_KEYS

NTZ = "timestamp_ntz"

# The conversation turns as the cleaning stage leaves them.
_TURNS = f"""
SELECT CASE WHEN turn > 0 THEN conv_id || '-' || turn
            ELSE substr(md5('conversations::conversations.json::' || ((conv_id << 20) + turn)), 1, 16) END AS message_id,
       conv_id, turn, role, {sql.clean("text")} AS body
FROM conversations WHERE text IS NOT NULL AND {sql.strip("text")} <> '' AND length({sql.clean("text")}) >= 5
"""

_EVENT_KEPT = "(event_id % 4 = 2 OR event_type = 'view')"


@query(
    "canonical_messages",
    f"""
SELECT message_id, 'conversations' AS dataset, role AS actor, NULL::TIMESTAMP AS "timestamp",
       {sql.language("body")} AS language, body AS raw_text, 'conversations.json' AS source_file,
       '{{"recipient":"' || conv_id || '","turn":' || turn || '}}' AS metadata
FROM ({_TURNS})
""",
)
def canonical_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = canonical_messages(T.conversation_records(spark, sf_dir), T.CONVERSATIONS)
    return valid_rows(checked).withColumn("timestamp", F.col("timestamp").cast(NTZ))


@query(
    "canonical_documents",
    f"""
SELECT doc_id::VARCHAR AS message_id, 'documents' AS dataset, source AS actor,
       CASE WHEN doc_id % 3 = 0 THEN {sql.language(sql.clean("text"))} ELSE lang END AS language,
       md5({sql.clean("text")}) AS text_md5
FROM documents WHERE {sql.strip("text")} <> '' AND length({sql.clean("text")}) >= 5
""",
)
def canonical_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = canonical_messages(T.document_records(spark, sf_dir), T.DOCUMENTS)
    return valid_rows(checked).select(
        "message_id", "dataset", "actor", "language", F.md5("raw_text").alias("text_md5")
    )


@query(
    "canonical_events",
    f"""
SELECT event_id::VARCHAR AS message_id, user_id::VARCHAR AS actor,
       CASE WHEN event_id % 4 = 3 THEN date_trunc('second', ts) ELSE date_trunc('milliseconds', ts) END AS "timestamp",
       event_type || ' ' || props AS raw_text, 'events_' || (event_id % 4) || '.json' AS source_file,
       props->>'k' AS recipient, "value"
FROM events WHERE {_EVENT_KEPT}
""",
)
def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = canonical_messages(T.event_records(spark, sf_dir), T.EVENTS)
    return decode_metadata(valid_rows(checked)).select(
        "message_id",
        "actor",
        F.col("timestamp").cast(NTZ).alias("timestamp"),
        "raw_text",
        "source_file",
        F.try_variant_get("metadata", "$.recipient", "string").alias("recipient"),
        F.try_variant_get("metadata", "$.value", "double").alias("value"),
    )


@query(
    "run_summary",
    f"""
WITH done AS (SELECT {sql.language("body")} AS language FROM ({_TURNS})),
     langs AS (SELECT language, count(*) AS n FROM done GROUP BY language)
SELECT 'conversations' AS dataset, (SELECT count(*) FROM conversations) AS records_raw,
       (SELECT count(*) FROM conversations) AS records_after_normalize,
       (SELECT count(*) FROM done) AS records_after_clean, (SELECT count(*) FROM done) AS records_written,
       round(1 - (SELECT count(*) FROM done) / (SELECT count(*) FROM conversations), 4) AS drop_rate,
       (SELECT string_agg(language || '=' || n, ',' ORDER BY language) FROM langs) AS languages
""",
)
def conversations_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = T.conversation_records(spark, sf_dir)
    summary = run_summary(
        T.CONVERSATIONS.name, flag_events(records, T.CONVERSATIONS), canonical_messages(records, T.CONVERSATIONS)
    )
    pairs = F.transform(
        F.map_entries("language_distribution"), lambda entry: F.concat_ws("=", entry["key"], entry["value"])
    )
    return summary.withColumn("languages", F.array_join(pairs, ",")).drop("language_distribution")


@query(
    "event_run_summary",
    f"""
SELECT 'events' AS dataset, (SELECT count(*) FROM events) AS records_raw,
       (SELECT count(*) FROM events WHERE {_EVENT_KEPT}) AS records_after_normalize,
       (SELECT count(*) FROM events WHERE {_EVENT_KEPT}) AS records_written,
       round(1 - (SELECT count(*) FROM events WHERE {_EVENT_KEPT}) / (SELECT count(*) FROM events), 4) AS drop_rate
""",
)
def events_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = T.event_records(spark, sf_dir)
    summary = run_summary(T.EVENTS.name, flag_events(records, T.EVENTS), canonical_messages(records, T.EVENTS))
    return summary.drop("language_distribution", "records_after_clean")


# --- projections -------------------------------------------------------------


@query(
    "alias_resolution",
    """
SELECT CASE WHEN turn > 0 THEN conv_id || '-' || turn END AS msg_id, role AS sender,
       conv_id::VARCHAR AS recipient, text AS body, 'conversations.json' AS source_file, '{"turn":' || turn || '}' AS extras
FROM conversations
""",
)
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = normalize(T.conversation_records(spark, sf_dir), T.CONVERSATIONS)
    return resolved.select(
        "msg_id", "sender", "recipient", "body", "source_file", F.to_json("extras").alias("extras")
    )


@query(
    "exploration_projection",
    """
SELECT CASE WHEN turn > 0 THEN conv_id || '-' || turn END AS msg_id, NULL::TIMESTAMP AS "timestamp", role AS sender,
       conv_id::VARCHAR AS recipient, text AS body, 'conversations.json' AS source_file
FROM conversations
""",
)
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = normalize(T.conversation_records(spark, sf_dir), T.CONVERSATIONS)
    return exploration_projection(resolved).withColumn("timestamp", F.col("timestamp").cast(NTZ))


@query(
    "nested_body",
    f"SELECT event_id::VARCHAR AS msg_id, event_type || ' ' || props AS body FROM events WHERE {_EVENT_KEPT}",
)
def nested_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(T.event_records(spark, sf_dir), T.EVENTS).select("msg_id", "body")


@query(
    "body_promotion",
    """
SELECT doc_id::VARCHAR AS msg_id, md5(text) AS body_md5,
       CASE doc_id % 3 WHEN 0 THEN 'lk_priority,lk_status,message,priority,status'
            WHEN 1 THEN 'description,lk_priority,lk_status,priority,status'
            ELSE 'lk_priority,lk_status,priority,status' END AS extra_fields
FROM documents
""",
)
def body_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(T.document_records(spark, sf_dir), T.DOCUMENTS).select(
        "msg_id",
        F.md5("body").alias("body_md5"),
        F.array_join(F.array_sort(F.map_keys("extras")), ",").alias("extra_fields"),
    )


@query(
    "prefixed_passthrough",
    "SELECT doc_id::VARCHAR AS msg_id, lang AS lk_status, n_chars AS lk_priority, lang AS status FROM documents",
)
def passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    def extra(name: str, kind: str):
        return F.try_variant_get(F.element_at("extras", F.lit(name)), "$", kind).alias(name)

    return normalize(T.document_records(spark, sf_dir), T.DOCUMENTS).select(
        "msg_id", extra("lk_status", "string"), extra("lk_priority", "bigint"), extra("status", "string")
    )


@query(
    "message_ids",
    """
SELECT conv_id, turn, CASE WHEN turn > 0 THEN conv_id || '-' || turn
       ELSE substr(md5('conversations::conversations.json::' || turn), 1, 16) END AS message_id,
       substr(md5(text), 1, 16) AS text_key
FROM conversations
""",
)
def message_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = T.table(spark, sf_dir, "conversations")
    given = F.when(F.col("turn") > 0, F.concat(F.lit(" "), "conv_id", F.lit("-"), "turn")).otherwise(F.lit("  "))
    return turns.select(
        "conv_id",
        "turn",
        C.message_id("conversations", F.lit("conversations.json"), F.col("turn"), given).alias("message_id"),
        md5_prefix(F.col("text")).alias("text_key"),
    )


@query(
    "metadata_decode",
    """
SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE (props->>'k')::BIGINT END AS k FROM events
""",
)
def metadata_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoiled = F.when(F.col("event_type") == "view", F.lit(None)).when(
        F.col("event_type") == "click", F.lit("{broken")
    ).otherwise(F.col("props"))
    events = T.table(spark, sf_dir, "events").withColumn("metadata", spoiled)
    return decode_metadata(events).select("event_id", F.try_variant_get("metadata", "$.k", "bigint").alias("k"))


@query(
    "metadata_assembly",
    f"""
SELECT event_id::VARCHAR AS message_id, props->>'k' AS recipient, event_type AS type_field,
       event_type || ' ' || props AS content_body, NULL::VARCHAR AS event_id_field
FROM events WHERE event_type = 'view' AND event_id % 4 <> 2
UNION ALL
SELECT event_id::VARCHAR, props->>'k', NULL, event_type || ' ' || props, NULL FROM events WHERE event_id % 4 = 2
""",
)
def metadata_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = canonical_messages(T.event_records(spark, sf_dir), T.EVENTS)

    def field(path: str):
        return F.try_variant_get("metadata", path, "string")

    return decode_metadata(checked, strict=True).select(
        "message_id",
        field("$.recipient").alias("recipient"),
        field("$.type").alias("type_field"),
        field("$.content.body").alias("content_body"),
        field("$.event_id").alias("event_id_field"),
    )


# --- filters and validation --------------------------------------------------------


@query(
    "body_filters",
    f"""
SELECT conv_id, turn, body FROM (
  SELECT conv_id, turn, {sql.clean("CASE role WHEN 'system' THEN NULL WHEN 'user' THEN text ELSE chr(160) || chr(9) || text END")} AS body
  FROM conversations
  UNION ALL SELECT conv_id, -1 - turn, {sql.clean("chr(160) || role || chr(10)")} FROM conversations)
WHERE body <> '' AND length(body) >= 5
""",
)
def body_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Null for one role, odd spaces before the texts of another; short bodies come from rows of roles alone.
    body = F.when(F.col("role") == "system", F.lit(None)).when(F.col("role") == "user", F.col("text")).otherwise(
        F.concat(F.lit("\xa0\t"), F.col("text"))
    )
    table = T.table(spark, sf_dir, "conversations")
    roles = table.withColumns({"turn": -1 - F.col("turn"), "body": F.concat(F.lit("\xa0"), "role", F.lit("\n"))})
    turns = table.withColumn("body", body).unionByName(roles)
    return C.clean_bodies(turns).select("conv_id", "turn", "body")


@query(
    "event_type_filter",
    f"SELECT event_id::VARCHAR AS msg_id, event_id % 4 AS file_no FROM events WHERE {_EVENT_KEPT}",
)
def event_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = normalize(T.event_records(spark, sf_dir), T.EVENTS)
    return kept.select("msg_id", F.substring("record_file", 8, 1).cast("bigint").alias("file_no"))


_SPOILED_SQL = """
SELECT conv_id, turn, CASE WHEN role = 'system' THEN ' ' ELSE conv_id || '-' || turn END AS message_id,
       CASE WHEN turn = 1 THEN NULL WHEN turn = 2 THEN chr(160) ELSE text END AS raw_text, 'conversations' AS dataset
FROM conversations
"""


def _spoiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "system", F.lit(" ")).otherwise(F.concat_ws("-", "conv_id", "turn")).alias("message_id"),
        F.when(F.col("turn") == 1, F.lit(None)).when(F.col("turn") == 2, F.lit("\xa0")).otherwise(F.col("text"))
        .alias("raw_text"),
        F.lit("conversations").alias("dataset"),
    )


@query(
    "rejected_rows",
    f"""
SELECT conv_id, turn, concat_ws('; ', CASE WHEN {sql.strip("message_id")} = '' THEN 'message_id must not be empty' END,
       CASE WHEN raw_text IS NULL OR {sql.strip("raw_text")} = '' THEN 'raw_text must not be empty' END) AS reasons
FROM ({_SPOILED_SQL}) WHERE {sql.strip("message_id")} = '' OR raw_text IS NULL OR {sql.strip("raw_text")} = ''
""",
)
def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = with_validation(_spoiled(spark, sf_dir))
    return rejected_rows(checked).select("conv_id", "turn", F.array_join("errors", "; ").alias("reasons"))


@query(
    "valid_rows",
    f"""
SELECT conv_id, turn, message_id FROM ({_SPOILED_SQL})
WHERE {sql.strip("message_id")} <> '' AND {sql.strip("raw_text")} <> ''
""",
)
def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_rows(with_validation(_spoiled(spark, sf_dir))).select("conv_id", "turn", "message_id")


@query("topic_subset", "SELECT doc_id, length(text) AS chars FROM documents WHERE lang = 'en' AND length(text) >= 20")
def topic_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = C.subset(T.document_messages(spark, sf_dir), "en", 20)
    return chosen.select("doc_id", F.length("raw_text").cast("bigint").alias("chars"))


@query(
    "language_fill",
    f"""
SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN lang ELSE {sql.language("text")} END AS language,
       lang NOT IN ('en', 'de') AS detected
FROM documents
""",
)
def language_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    preset = F.when(F.col("language").isin("en", "de"), F.col("language")).when(
        F.col("language") == "fr", F.lit("unknown")
    )
    messages = T.document_messages(spark, sf_dir).withColumn("language", preset)
    flagged = messages.withColumn("detected", needs_detection(F.col("language")))
    return C.fill_language(flagged, text="raw_text").select("doc_id", "language", "detected")


@query(
    "language_agreement",
    f"""
SELECT lang, {sql.language("text")} AS detected, count(*) AS documents FROM documents GROUP BY ALL
""",
)
def language_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = T.document_messages(spark, sf_dir).withColumnRenamed("language", "lang")
    labelled = C.fill_language(messages, text="raw_text", language="detected")
    return labelled.groupBy("lang", "detected").agg(F.count(F.lit(1)).alias("documents"))


@query(
    "date_range_flag",
    """
SELECT event_id, CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AS in_range FROM events
""",
)
def date_range_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = C.flag_date_range(T.event_messages(spark, sf_dir), ("2024-01-10", "2024-01-20"))
    return flagged.select(F.col("message_id").alias("event_id"), "in_range")


@query("expected_language_flag", "SELECT doc_id, lang IN ('en', 'de') AS expected_language FROM documents")
def expected_language_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = C.flag_expected_language(T.document_messages(spark, sf_dir), ("en", "de"))
    return flagged.select("doc_id", "expected_language")


# --- scalar functions ---------------------------------------------------------------

_MESSY_SQL = "replace(replace(text, '. ', '.' || chr(13) || chr(10) || chr(13) || chr(13) || chr(9) || ' '), ', ', ',' || chr(9) || '  ')"


def _messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with tabs, runs of spaces and mixed line ends in place of plain ones."""
    text = F.replace(F.col("text"), F.lit(". "), F.lit(".\r\n\r\r\t "))
    return T.table(spark, sf_dir, "documents").select("doc_id", F.replace(text, F.lit(", "), F.lit(",\t  ")).alias("text"))


@query(
    "clean_text",
    f"SELECT doc_id, md5(body) AS body_md5, length(body) AS body_len FROM (SELECT doc_id, {sql.clean(_MESSY_SQL)} AS body FROM documents)",
)
def clean_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = _messy(spark, sf_dir).select("doc_id", clean_text(F.col("text")).alias("body"))
    return cleaned.select("doc_id", F.md5("body").alias("body_md5"), F.length("body").cast("bigint").alias("body_len"))


@query(
    "clean_body",
    f"SELECT doc_id, md5(body) AS body_md5, length(body) AS body_len FROM (SELECT doc_id, {sql.clean(_MESSY_SQL, collapse=False)} AS body FROM documents)",
)
def clean_body_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = _messy(spark, sf_dir).select("doc_id", clean_text(F.col("text"), collapse_newlines=False).alias("body"))
    return cleaned.select("doc_id", F.md5("body").alias("body_md5"), F.length("body").cast("bigint").alias("body_len"))


@query(
    "parse_timestamps",
    """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('second', ts) END AS parsed FROM events
""",
)
def parse_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    text = (
        F.when(F.col("event_type") == "view", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("event_type") == "click", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("event_type") == "purchase", F.date_format(ts, "dd.MM.yyyy HH:mm:ss"))
        .when(F.col("event_type") == "signup", F.unix_seconds(ts).cast("string"))
        .otherwise(F.lit("not a time"))
    )
    events = T.table(spark, sf_dir, "events")
    return events.select("event_id", parse_timestamp(text).cast(NTZ).alias("parsed"))


@query(
    "epoch_timestamps",
    f"""
SELECT event_id::VARCHAR AS msg_id,
       CASE WHEN event_id % 4 = 3 THEN date_trunc('second', ts) ELSE date_trunc('milliseconds', ts) END AS "timestamp"
FROM events WHERE {_EVENT_KEPT}
""",
)
def epoch_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = normalize(T.event_records(spark, sf_dir), T.EVENTS)
    return resolved.select("msg_id", F.col("timestamp").cast(NTZ).alias("timestamp"))


@query(
    "text_chunks",
    """
SELECT doc_id, i AS chunk_no, md5(substr(text, (i * 512 + 1)::BIGINT, 512)) AS chunk_md5
FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 512 + 1)) AS i FROM documents WHERE length(text) > 0)
""",
)
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = T.table(spark, sf_dir, "documents")
    cut = documents.select("doc_id", F.posexplode(chunks(F.col("text"), 512)).alias("chunk_no", "chunk"))
    return cut.select("doc_id", F.col("chunk_no").cast("bigint"), F.md5("chunk").alias("chunk_md5"))


@query(
    "unit_vectors",
    """
WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE * (vec_id % 7 + 1) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
     n AS (SELECT vec_id, sqrt(sum(x * x)) AS norm, count(*) AS dims FROM v GROUP BY vec_id)
SELECT vec_id, dims, 1.0::DOUBLE AS unit_norm,
       round(max(CASE WHEN i = 1 THEN x / norm END), 6) AS first_value, round(sum(x / norm), 6) AS value_sum
FROM v JOIN n USING (vec_id) GROUP BY vec_id, dims
""",
)
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = T.table(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 7 + 1))
    unit = vectors.select("vec_id", l2_normalize(scaled).alias("unit"))
    return unit.select(
        "vec_id",
        F.size("unit").cast("bigint").alias("dims"),
        F.round(l2_norm(F.col("unit")), 6).alias("unit_norm"),
        F.round(F.col("unit")[0], 6).alias("first_value"),
        F.round(F.aggregate("unit", F.lit(0.0), lambda total, x: total + x), 6).alias("value_sum"),
    )


# --- sets, duplicates, samples ---------------------------------------------------------


@query(
    "union_by_name",
    """
SELECT conv_id, turn, role, NULL::BIGINT AS doc_id, NULL::VARCHAR AS lang, md5(text) AS text_md5 FROM conversations
UNION ALL SELECT NULL, NULL, NULL, doc_id, lang, md5(text) FROM documents
""",
)
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = T.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))
    documents = T.table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_md5"), "lang")
    both = turns.unionByName(documents, allowMissingColumns=True)
    return both.select("conv_id", "turn", "role", "doc_id", "lang", "text_md5")


@query(
    "dedup_keep_first",
    """
SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS rn FROM documents)
WHERE rn = 1
""",
)
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = T.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return C.keep_first(documents, ["text"], ["source", "doc_id"]).select("doc_id", "source")


@query("full_row_dedup", "SELECT DISTINCT md5(text) AS text_md5, lang FROM documents")
def full_row_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = T.table(spark, sf_dir, "documents")
    return C.drop_copied_rows(documents.select(F.md5("text").alias("text_md5"), "lang"))


@query(
    "exploration_dedup",
    """
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1
""",
)
def exploration_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = T.table(spark, sf_dir, "documents")
    rows = documents.select(F.lit(None).cast("string").alias("msg_id"), "text", "lang", "doc_id")
    return C.exploration_dedup(rows, ["doc_id"]).select("doc_id")


@query(
    "corpora_union",
    f"""
WITH m AS (
  SELECT 'conversations' AS dataset, {sql.language("body")} AS language FROM ({_TURNS})
  UNION ALL SELECT 'documents', CASE WHEN doc_id % 3 = 0 THEN {sql.language(sql.clean("text"))} ELSE lang END
  FROM documents WHERE {sql.strip("text")} <> '' AND length({sql.clean("text")}) >= 5
  UNION ALL SELECT 'events', {sql.language("event_type || ' ' || props")} FROM events WHERE {_EVENT_KEPT})
SELECT dataset, language, count(*) AS messages FROM m GROUP BY ALL
""",
)
def corpora_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpora = all_corpora(spark, sf_dir)
    return corpora.groupBy("dataset", "language").agg(F.count(F.lit(1)).alias("messages"))


def all_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical rows of the three corpora, one below the other."""
    parts = [
        (T.conversation_records, T.CONVERSATIONS),
        (T.document_records, T.DOCUMENTS),
        (T.event_records, T.EVENTS),
    ]
    frames = [valid_rows(canonical_messages(read(spark, sf_dir), spec)) for read, spec in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(
    "capped_sample",
    """
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS rn
FROM documents WHERE lang IN ('en', 'fr', 'es')) WHERE rn <= 120
""",
)
def sample_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = T.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return capped_sample(documents, "lang", "doc_id", cap=120, groups=("en", "fr", "es"))


@query(
    "capped_sample_any_group",
    """
SELECT event_id, user_id FROM (SELECT event_id, user_id,
  row_number() OVER (PARTITION BY user_id ORDER BY md5('7:' || event_id), event_id) AS rn FROM events) WHERE rn <= 50
""",
)
def sample_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = T.table(spark, sf_dir, "events").select("event_id", "user_id")
    return capped_sample(events, "user_id", "event_id", cap=50, seed=7)




def _pieces(documents: DataFrame) -> DataFrame:
    """Texts of JSON documents as the pieces and ranges a scan would give: up to a closing brace, seven to a range."""
    # A select that explodes would split the whole text again for every piece, if it used the text beside the explode.
    parts = F.split(F.regexp_replace("text", r"\}\z", ""), r"\}")
    documents = with_computed(documents.where("text <> ''"), {"size": F.octet_length("text"), "parts": parts})
    pieces = documents.select("path", "size", F.posexplode("parts").alias("seen", "value"))
    return pieces.withColumn("range", F.floor(F.col("seen") / 7))


@query(
    "json_envelope_ranges",
    """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, turn, role, text FROM conversations
""",
)
def json_envelope_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as objects with a message list between other fields, cut into records range by range."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    text = F.format_string('{"conv": {"id": [%d, {"}": "]{"}]}, "messages": %s, "n": %d}', "conv_id", F.to_json(turns), F.count("*"))
    documents = T.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("path")).agg(text.alias("text"))
    items = cut_records(_pieces(documents), DEFAULT_ENVELOPE_KEYS)
    fields = [F.try_variant_get(F.col("rec")[name], "$", kind).alias(name) for name, kind in (("turn", "bigint"), ("role", "string"), ("text", "string"))]
    return items.select(F.col("path").alias("conv_id"), "ordinal", *fields)


@query(
    "json_array_ranges",
    """
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ordinal, event_id, event_type, props FROM events
""",
)
def json_array_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one list a user, with objects in strings and in records, cut into records range by range."""
    events = F.array_sort(F.collect_list(F.struct("event_id", F.struct("event_type", "props").alias("content"))))
    documents = T.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("path")).agg(F.to_json(events).alias("text"))
    items = cut_records(_pieces(documents), DEFAULT_ENVELOPE_KEYS)
    content = [F.try_variant_get(F.col("rec")["content"], f"$.{name}", "string").alias(name) for name in ("event_type", "props")]
    return items.select(F.col("path").alias("user_id"), "ordinal", F.try_variant_get(F.col("rec")["event_id"], "$", "bigint").alias("event_id"), *content)
