"""Queries for distributions, terms, search, vectors, indicators and actors."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatseam.functions.checksums import base58check, bech32, mixed_case
from chatseam.functions.once import with_computed
from chatseam.functions.text import tokens
from chatseam.operators import actors as A
from chatseam.operators import clean as C
from chatseam.operators import density as D
from chatseam.operators import explore as E
from chatseam.operators import indicators as I
from chatseam.operators import search as S
from chatseam.operators import similarity as V
from chatseam.operators import terms as W
from chatseam.operators.neighbours import neighbour_lists
from chatseam.operators.summary import catalog_counts
from chatseam.plans import sql
from chatseam.plans import tables as T
from chatseam.plans.ingest_queries import all_corpora
from chatseam.plans.registry import query
from chatseam.sources.parquet import parquet_totals, read_parquet

# English words left out of terms and topics in the registered queries.
STOP_WORDS = (
    "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or",
    "that", "the", "this", "to", "was", "with",
)

NTZ = "timestamp_ntz"


def _rounded(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({name: F.round(name, 6) for name in columns})


# --- Parquet -----------------------------------------------------------------


@query("parquet_projection", "SELECT doc_id, lang FROM documents")
def parquet_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/documents.parquet", ["doc_id", "lang"])


_INFO_TABLES = (
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation",
    "orders", "pages", "part", "region", "supplier",
)


@query(
    "parquet_info",
    " UNION ALL ".join(
        f"SELECT '{name}.parquet' AS file, count(*) AS rows,"
        f" (SELECT count(*) FROM (DESCRIBE {name})) AS column_count FROM {name}"
        for name in _INFO_TABLES
    ),
)
def parquet_file_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = [parquet_totals(spark, f"{sf_dir}/{name}.parquet") for name in _INFO_TABLES]
    info = frames[0]
    for frame in frames[1:]:
        info = info.unionByName(frame)
    return info.select(
        F.substring_index("path", "/", -1).alias("file"),
        "rows",
        F.size("columns").cast("bigint").alias("column_count"),
    )


# --- distributions -------------------------------------------------------------


@query(
    "corpus_catalog",
    f"""
SELECT * FROM (VALUES ('babuk', false, 'babuk', 0), ('black_basta', false, 'black_basta', 0), ('conti', false, 'conti', 0),
  ('custom', false, 'custom', 0), ('hack_forums', false, 'hack_forums', 0), ('lockbit', false, 'lockbit', 0))
  AS listed(name, enabled, display_name, messages)
UNION ALL SELECT 'conversations', false, 'Assistant conversations',
  (SELECT count(*) FROM conversations WHERE length({sql.clean("text")}) >= 5)
UNION ALL SELECT 'documents', false, 'Documents as tickets', (SELECT count(*) FROM documents WHERE length({sql.clean("text")}) >= 5)
UNION ALL SELECT 'events', false, 'Event export', (SELECT count(*) FROM events WHERE event_id % 4 = 2 OR event_type = 'view')
""",
)
def corpus_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_counts(all_corpora(spark, sf_dir), T.SPECS)


@query(
    "language_distribution",
    "SELECT lang AS language, count(*) AS messages FROM documents WHERE lang IS NOT NULL GROUP BY lang",
)
def language_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.language_distribution(T.document_messages(spark, sf_dir))


@query(
    "top_senders",
    """
SELECT user_id AS sender, count(*) AS messages FROM events WHERE user_id IS NOT NULL GROUP BY user_id
ORDER BY messages DESC, sender LIMIT 20
""",
)
def top_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.top_senders(T.event_messages(spark, sf_dir), 20)


@query(
    "daily_volume",
    """
WITH c AS (SELECT CAST(ts AS DATE) AS day, count(event_type) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1),
     spine AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM c), (SELECT max(day) FROM c), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT day, coalesce(n, 0) AS messages FROM spine LEFT JOIN c USING (day)
""",
)
def daily_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.daily_volume(T.event_messages(spark, sf_dir))


@query(
    "weekly_volume",
    """
WITH c AS (SELECT event_type AS language, CAST(date_trunc('week', ts) AS DATE) + 6 AS week, count(event_type) AS n
           FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY 1, 2),
     r AS (SELECT language, min(week) AS low, max(week) AS high FROM c GROUP BY language),
     spine AS (SELECT language, CAST(unnest(generate_series(low, high, INTERVAL 7 DAY)) AS DATE) AS week FROM r)
SELECT language, week, coalesce(n, 0) AS messages FROM spine LEFT JOIN c USING (language, week)
""",
)
def weekly_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The events carry no language; their type takes its place.
    return E.weekly_volume(
        T.event_messages(spark, sf_dir), languages=("view", "click", "error"), language="event_type"
    )


@query(
    "weekly_volume_by_user",
    """
WITH c AS (SELECT user_id, CAST(date_trunc('week', ts) AS DATE) + 6 AS week, count(*) AS n FROM events GROUP BY 1, 2),
     r AS (SELECT user_id, min(week) AS low, max(week) AS high FROM c GROUP BY user_id),
     spine AS (SELECT user_id, CAST(unnest(generate_series(low, high, INTERVAL 7 DAY)) AS DATE) AS week FROM r)
SELECT user_id, count(*) AS weeks, sum(coalesce(n, 0))::BIGINT AS messages, count(*) FILTER (n IS NULL) AS empty_weeks
FROM spine LEFT JOIN c USING (user_id, week) GROUP BY user_id
""",
)
def volume_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = T.event_messages(spark, sf_dir)
    sunday = F.date_add(F.date_trunc("week", "timestamp").cast("date"), 6)
    counts = messages.groupBy(F.col("actor").alias("user_id"), sunday.alias("week")).agg(F.count(F.lit(1)).alias("n"))
    filled = E.fill_gaps(counts, ["user_id"], "week", "n", 7)
    return filled.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("weeks"), F.sum("n").alias("messages"), F.count_if(F.col("n") == 0).alias("empty_weeks")
    )


@query(
    "length_histogram",
    """
WITH l AS (SELECT least(length(text), 1000) AS x FROM documents),
     e AS (SELECT min(x)::DOUBLE AS low, max(x)::DOUBLE AS high FROM l),
     b AS (SELECT least(floor((x - low) * 60 / (high - low))::INTEGER + 1, 60) AS bin FROM l, e),
     n AS (SELECT bin, count(*) AS c FROM b GROUP BY bin)
SELECT i::INTEGER AS bin, round(low + (i - 1) * ((high - low) / 60), 6) AS bin_start,
       round(low + i * ((high - low) / 60), 6) AS bin_end, coalesce(c, 0) AS messages
FROM (SELECT unnest(range(1, 61)) AS i) CROSS JOIN e LEFT JOIN n ON n.bin = i
""",
)
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = T.document_messages(spark, sf_dir).select(F.length("raw_text").alias("body_len"))
    return _rounded(E.length_histogram(lengths), "bin_start", "bin_end")


@query(
    "length_describe",
    """
SELECT count(x) AS "count", round(avg(x), 6) AS mean, round(stddev(x), 6) AS std, min(x)::DOUBLE AS "min",
       round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50,
       round(quantile_cont(x, 0.75), 6) AS q75, max(x)::DOUBLE AS "max"
FROM (SELECT length(text)::DOUBLE AS x FROM documents)
""",
)
def length_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = T.document_messages(spark, sf_dir).select(F.length("raw_text").alias("body_len"))
    return _rounded(E.describe(lengths, "body_len"), "mean", "std", "q25", "q50", "q75")


@query("column_median", 'SELECT round(median("value"), 6) AS median_value FROM events')
def column_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    median = E.exact_quantiles(T.table(spark, sf_dir, "events"), "value", (0.5,))
    return median.select(F.round("q0", 6).alias("median_value"))


@query(
    "presence_checks",
    """
SELECT 'ts' AS "column", count(ts) AS present, count(ts) > 0 AS any_present FROM events
UNION ALL SELECT 'user_id', count(user_id), count(user_id) > 0 FROM events
UNION ALL SELECT 'large_value', count(*) FILTER (value > 10), count(*) FILTER (value > 10) > 0 FROM events
UNION ALL SELECT 'never', 0, false
""",
)
def presence_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = T.table(spark, sf_dir, "events").select(
        "ts",
        "user_id",
        F.when(F.col("value") > 10, F.col("value")).alias("large_value"),
        F.lit(None).cast("string").alias("never"),
    )
    return E.presence(events, ["ts", "user_id", "large_value", "never"])


@query("time_order", 'SELECT event_id AS message_id, ts AS "timestamp" FROM events')
def time_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = E.by_time(T.event_messages(spark, sf_dir).select("message_id", "timestamp"))
    return ordered.withColumn("timestamp", F.col("timestamp").cast(NTZ))


@query("head", "SELECT event_id AS message_id, event_type FROM events ORDER BY ts NULLS LAST, event_id LIMIT 100")
def head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.head(T.event_messages(spark, sf_dir), 100).select("message_id", "event_type")


# --- terms and topics ----------------------------------------------------------------

_TERMS = f"""
SELECT doc_id, source, words || {sql.bigrams("words")} AS terms, len(words) AS n_words
FROM (SELECT doc_id, source, {sql.tokens("text", STOP_WORDS)} AS words FROM documents)
"""


@query(
    "tokens_and_bigrams",
    f"SELECT doc_id, n_words, len(terms) AS n_terms, md5(array_to_string(terms, '|')) AS terms_md5 FROM ({_TERMS})",
)
def tokens_and_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = T.document_messages(spark, sf_dir)
    found = documents.select("doc_id", W.terms(F.col("raw_text"), STOP_WORDS).alias("terms"))
    words = F.filter("terms", lambda term: ~term.contains(" "))
    return found.select(
        "doc_id",
        F.size(words).cast("bigint").alias("n_words"),
        F.size("terms").cast("bigint").alias("n_terms"),
        F.md5(F.array_join("terms", "|")).alias("terms_md5"),
    )


@query(
    "vocabulary",
    f"""
SELECT term, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(terms) AS term FROM ({_TERMS}))
GROUP BY term HAVING count(DISTINCT doc_id) >= 5
""",
)
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.document_frequencies(T.document_messages(spark, sf_dir), min_df=5, stop_words=STOP_WORDS)


@query(
    "term_counts",
    f"""
WITH t AS (SELECT doc_id, unnest(terms) AS term FROM ({_TERMS})),
     n AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL),
     v AS (SELECT term FROM n GROUP BY term HAVING count(*) >= 5)
SELECT doc_id, count(*) AS distinct_terms, sum(n)::BIGINT AS terms, max(n) AS most FROM n JOIN v USING (term) GROUP BY doc_id
""",
)
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = T.document_messages(spark, sf_dir)
    counts = W.vocabulary_counts(documents, key="doc_id", min_df=5, stop_words=STOP_WORDS)
    return counts.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("distinct_terms"), F.sum("n").alias("terms"), F.max("n").alias("most")
    )


_WEIGHTS = f"""
WITH t AS (SELECT source AS topic, unnest(terms) AS term FROM ({_TERMS})),
     n AS (SELECT topic, term, count(*) AS n FROM t GROUP BY ALL),
     k AS (SELECT *, sum(n) OVER (PARTITION BY term) AS everywhere, count(*) OVER (PARTITION BY term) AS df FROM n),
     m AS (SELECT * FROM k WHERE df >= 5),
     s AS (SELECT topic, sum(n) AS size FROM m GROUP BY topic),
     w AS (SELECT topic, term, n, n / size * ln(1 + (SELECT avg(size) FROM s) / everywhere) AS weight FROM m JOIN s USING (topic)),
     r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 12) DESC, term) AS rank FROM w)
"""


def _keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = W.class_term_weights(
        T.document_messages(spark, sf_dir), topic="actor", min_df=5, stop_words=STOP_WORDS
    )
    return W.topic_keywords(weights, top=10, outlier=None)


@query(
    "topic_keywords",
    f"{_WEIGHTS} SELECT topic, term, n, round(weight, 6) AS weight, rank FROM r WHERE rank <= 10",
)
def topic_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    keywords = _rounded(_keywords(spark, sf_dir), "weight")
    return keywords.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "topic_info",
    f"""
{_WEIGHTS}, info AS (SELECT topic, string_agg(term, ',' ORDER BY rank) AS words,
                            string_agg(term, '_' ORDER BY rank) FILTER (rank <= 4) AS first_words FROM r WHERE rank <= 10 GROUP BY topic)
SELECT source AS topic, count(*) AS "count", source || '_' || any_value(first_words) AS name, any_value(words) AS words
FROM documents LEFT JOIN info ON info.topic = source GROUP BY source ORDER BY count(*) DESC, source LIMIT 20
""",
)
def topic_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = T.document_messages(spark, sf_dir)
    info = W.topic_info(documents, _keywords(spark, sf_dir), topic="actor", outlier=None)
    return info.withColumn("words", F.array_join("words", ","))


@query(
    "topic_attach",
    "SELECT doc_id, source AS actor, quality AS topic FROM documents JOIN labels USING (doc_id)",
)
def topic_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = T.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("topic"))
    documents = T.document_messages(spark, sf_dir).select("doc_id", "actor")
    return W.attach_topics(documents, topics, "doc_id")


# --- search -------------------------------------------------------------------------

SEARCHES = {"english": "the tion and hahaha", "german": "nicht die verein nicht", "mixed": "pour teach los ing"}


def _bm25_sql(searches: dict[str, str]) -> str:
    terms = [(name, term, place) for name, text in searches.items() for place, term in enumerate(S.query_terms(text))]
    rows = ", ".join(f"('{name}', '{term}', {place})" for name, term, place in terms)
    return f"""
WITH q AS (SELECT * FROM (VALUES {rows}) AS v(query, term, place)),
     d AS (SELECT doc_id, {sql.tokens("text")} AS words FROM documents),
     f AS (SELECT count(*) AS n, avg(len(words)) AS mean_length FROM d),
     tf AS (SELECT doc_id, len(words) AS length, term, len(list_filter(words, lambda w: w = term)) AS tf
            FROM d, (SELECT DISTINCT term FROM q)),
     df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
     part AS (SELECT query, doc_id, tf, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length)) AS s
              FROM tf JOIN df USING (term) JOIN q USING (term), f),
     text_score AS (SELECT query, doc_id, sum(s) AS score FROM part WHERE tf > 0 GROUP BY query, doc_id)
"""


@query(
    "bm25",
    f"""
{_bm25_sql(SEARCHES)}
SELECT query, doc_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS rank FROM text_score)
WHERE rank <= 10
""",
)
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.bm25_search(T.document_messages(spark, sf_dir), SEARCHES, key="doc_id")
    return _rounded(found, "score").withColumn("rank", F.col("rank").cast("bigint"))


def _dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


def _cosine_sql(a: str, b: str) -> str:
    return f"{_dot_sql(a, b)} / (sqrt({_dot_sql(a, a)}) * sqrt({_dot_sql(b, b)}))"


@query(
    "hybrid_search",
    f"""
{_bm25_sql({"english": SEARCHES["english"]})},
     vs AS (SELECT vec_id AS doc_id, {_cosine_sql("embedding", "target")} AS score
            FROM embeddings, (SELECT embedding AS target FROM embeddings ORDER BY vec_id LIMIT 1)),
     te AS (SELECT min(score) AS low, max(score) AS high FROM text_score),
     ve AS (SELECT min(score) AS low, max(score) AS high FROM vs),
     tn AS (SELECT doc_id, (score - low) / (high - low) AS text_score FROM text_score, te),
     vn AS (SELECT doc_id, (score - low) / (high - low) AS vector_score FROM vs, ve),
     j AS (SELECT doc_id, coalesce(text_score, 0) AS text_score, coalesce(vector_score, 0) AS vector_score
           FROM tn FULL JOIN vn USING (doc_id))
SELECT doc_id, round(text_score, 6) AS text_score, round(vector_score, 6) AS vector_score,
       round(0.7 * vector_score + 0.3 * text_score, 6) AS score
FROM j ORDER BY round(0.7 * vector_score + 0.3 * text_score, 9) DESC, doc_id LIMIT 10
""",
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    search = {"english": SEARCHES["english"]}
    by_text = S.bm25_scores(T.document_messages(spark, sf_dir), search, key="doc_id").select("doc_id", "score")
    vectors = T.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    target = vectors.orderBy("doc_id").limit(1).select("embedding").scalar()
    by_vector = S.vector_scores(vectors, target, "doc_id", "embedding")
    return _rounded(S.hybrid_search(by_text, by_vector, "doc_id"), "text_score", "vector_score", "score")


# --- vectors --------------------------------------------------------------------------

_TARGETS = f"""
WITH c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
           FROM embeddings) GROUP BY label, i),
     t AS (SELECT label AS technique, list(m ORDER BY i) AS target FROM c GROUP BY label),
     v AS ({{vectors}}),
     s AS (SELECT vec_id, technique, {_cosine_sql("embedding", "target")} AS score FROM v, t),
     r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 12) DESC, technique) AS rank FROM s WHERE score >= {{threshold}})
"""


_GIVEN = "SELECT vec_id, embedding FROM embeddings"
# Vectors drawn towards the mean of their label, by more or less, so that high thresholds have matches.
_PULL = 4
_DRAWN = f"""
SELECT vec_id, list_transform(list_zip(embedding, target), lambda p: p[1]::DOUBLE + {_PULL} * (vec_id % 4) * p[2]) AS embedding
FROM embeddings JOIN t ON t.technique = label
"""


def _label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.centroids(T.table(spark, sf_dir, "embeddings").withColumnRenamed("label", "technique"), "technique")


def drawn_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, embedding)`` drawn towards the means of the labels."""
    mean = _label_means(spark, sf_dir).select(F.col("technique").alias("label"), F.col("embedding").alias("mean"))
    pulled = F.zip_with("embedding", "mean", lambda x, m: x.cast("double") + _PULL * (F.col("vec_id") % 4) * m)
    return T.table(spark, sf_dir, "embeddings").join(mean, "label").select("vec_id", pulled.alias("embedding"))


def _techniques(spark: SparkSession, sf_dir: str, threshold: float, drawn: bool = False) -> DataFrame:
    vectors = drawn_vectors(spark, sf_dir) if drawn else T.table(spark, sf_dir, "embeddings")
    targets = _label_means(spark, sf_dir)
    found = V.nearest_targets(vectors, targets, "vec_id", "technique", threshold=threshold)
    return found.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "technique_matches",
    _TARGETS.format(threshold=0.3, vectors=_GIVEN) + "SELECT vec_id, technique, round(score, 6) AS score, rank FROM r WHERE rank <= 3",
)
def technique_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The given vectors lie further apart than encoded sentences, hence the lower threshold.
    return _rounded(_techniques(spark, sf_dir, 0.3), "score")


@query(
    "technique_matches_strict",
    _TARGETS.format(threshold=0.65, vectors=_DRAWN) + "SELECT vec_id, technique, round(score, 6) AS score, rank FROM r WHERE rank <= 3",
)
def technique_matches_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_techniques(spark, sf_dir, V.SIMILARITY_THRESHOLD, drawn=True), "score")


@query(
    "confident_entities",
    _TARGETS.format(threshold=0.3, vectors=_DRAWN)
    + "SELECT vec_id, technique, round(score, 6) AS score FROM r WHERE rank <= 3 AND score >= 0.7",
)
def confident_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = V.filter_confident(_techniques(spark, sf_dir, 0.3, drawn=True))
    return _rounded(entities, "score").select("vec_id", "technique", "score")


@query("hashed_tfidf")
def hashed_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = V.hashed_tfidf(T.document_messages(spark, sf_dir), stop_words=STOP_WORDS)
    return encoded.select("doc_id", "features")


@query("reduced_vectors")
def reduced_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    reduced = V.reduce_dimensions(T.table(spark, sf_dir, "embeddings"), k=5)
    return reduced.select("vec_id", "reduced")


@query("clusters")
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    reduced = V.reduce_dimensions(T.table(spark, sf_dir, "embeddings"), k=5)
    return V.cluster(reduced, vector="reduced", k=10, min_cluster_size=30).select("vec_id", "topic")


_NEIGHBOURS, _SAMPLES, _CLUSTER_SIZE = 10, 5, 10
_LISTS = f"""
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
     d AS (SELECT a.id, b.id AS neighbour, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.id <> b.id),
     r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS n FROM d),
     l AS (SELECT id, neighbour, distance, n FROM r WHERE n <= {_NEIGHBOURS})
"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_lists(T.table(spark, sf_dir, "embeddings"), "vec_id", k=_NEIGHBOURS)


@query("neighbour_lists", _LISTS + "SELECT id, neighbour, round(distance, 6) AS distance FROM l")
def vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_lists(spark, sf_dir), "distance")


@query(
    "mutual_reachability",
    _LISTS
    + f""",
     c AS (SELECT id, distance AS core FROM l WHERE n = {_SAMPLES})
SELECT least(l.id, neighbour) AS a, greatest(l.id, neighbour) AS b,
       round(min(greatest(distance, c.core, o.core)), 6) AS weight
FROM l JOIN c ON c.id = l.id JOIN c o ON o.id = neighbour GROUP BY ALL
""",
)
def mutual_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(D.mutual_reachability(_lists(spark, sf_dir), _SAMPLES), "weight")


@query("density_clusters")
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The given vectors as they are hold no denser places.
    vectors = drawn_vectors(spark, sf_dir)
    reduced = V.reduce_dimensions(vectors, k=5).select("vec_id", "reduced")
    lists = neighbour_lists(reduced, "vec_id", "reduced", _NEIGHBOURS)
    found = D.density_clusters(vectors.select(F.col("vec_id").alias("id")), D.mutual_reachability(lists, _SAMPLES), _CLUSTER_SIZE)
    return found.withColumnRenamed("id", "vec_id")


# What has no SQL equivalent still has facts that must hold, whatever the fit finds.


@query(
    "hashed_tfidf_facts",
    f"""
SELECT count(*) AS documents, count(*) FILTER (n > 0) AS unit_length, count(*) FILTER (n = 0) AS empty, 0::BIGINT AS over_full
FROM (SELECT len({sql.tokens("text", STOP_WORDS)}) AS n FROM documents)
""",
)
def hashed_tfidf_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = V.hashed_tfidf(T.document_messages(spark, sf_dir), stop_words=STOP_WORDS)
    measured = encoded.select(
        F.filter(vector_to_array("features"), lambda x: x != 0).alias("values"), F.size(tokens(F.col("raw_text"), STOP_WORDS)).alias("n")
    ).select("n", F.size("values").alias("filled"), F.aggregate("values", F.lit(0.0), lambda total, x: total + x * x).alias("length"))
    return measured.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.abs(F.col("length") - 1) < 1e-9).alias("unit_length"),
        F.count_if(F.col("length") == 0).alias("empty"),
        F.count_if(F.col("filled") > F.col("n")).alias("over_full"),
    )


@query(
    "reduced_vector_facts",
    """
SELECT i AS component, count(embedding) AS vectors, true AS falling, true AS uncorrelated
FROM (SELECT unnest(range(1, 6)) AS i) CROSS JOIN embeddings GROUP BY i
""",
)
def reduced_vector_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reduced = V.reduce_dimensions(T.table(spark, sf_dir, "embeddings"), k=5)
    values = [F.get("reduced", F.lit(i)) for i in range(5)]
    moments = reduced.agg(
        F.count(F.lit(1)).alias("vectors"),
        *(F.covar_pop(values[i], values[j]).alias(f"c{i}{j}") for i in range(5) for j in range(i, 5)),
    )
    rows = [
        F.struct(
            F.lit(i + 1).cast("bigint").alias("component"),
            "vectors",
            (F.col(f"c{i}{i}") <= F.col(f"c{max(i - 1, 0)}{max(i - 1, 0)}")).alias("falling"),
            (F.greatest(F.lit(0.0), *(F.abs(f"c{min(i, j)}{max(i, j)}") for j in range(5) if j != i)) < 1e-9).alias("uncorrelated"),
        )
        for i in range(5)
    ]
    return moments.select(F.inline(F.array(*rows)))


@query(
    "cluster_facts",
    """
SELECT count(*) AS vectors, 0::BIGINT AS repeated, 0::BIGINT AS under_size, 0::BIGINT AS unknown_topics FROM embeddings
""",
)
def cluster_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = clusters(spark, sf_dir)
    per_vector = topics.groupBy("vec_id", "topic").agg(F.count(F.lit(1)).alias("n"))
    per_topic = per_vector.groupBy("topic").agg(F.sum("n").alias("size"), F.sum(F.col("n") - 1).alias("repeated"))
    return per_topic.agg(
        F.sum("size").alias("vectors"),
        F.sum("repeated").alias("repeated"),
        F.count_if((F.col("topic") >= 0) & (F.col("size") < 30)).alias("under_size"),
        F.count_if(~F.col("topic").between(-1, 9)).alias("unknown_topics"),
    )


# --- indicators ------------------------------------------------------------------------

# Invented words of the given prose stand in for tool names.
TOOLS = (*I.TOOL_NAMES, "hahaha", "the by", "nicht")


def _sql_pattern(pattern: str) -> str:
    """The pattern without look-around, which the checking engine lacks."""
    pattern = pattern.replace(I.WORD_START, r"\b").replace(I.WORD_END, r"\b")
    return "'" + pattern.replace("'", "''") + "'"


def _indicator_sql(patterns: dict[str, str], table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return " UNION ALL ".join(
        f"SELECT {key}, '{kind}' AS kind, unnest(found) AS value, generate_subscripts(found, 1)::BIGINT AS start_no"
        f" FROM (SELECT {key}, regexp_extract_all({text}, {_sql_pattern(pattern)}) AS found FROM {table})"
        for kind, pattern in patterns.items()
    )


# Every character between words is doubled, so that two names can each take one
# as their border; names with a space are written with two.
_TOOL_SQL = rf"""
SELECT doc_id, 'tool' AS kind, replace(unnest(found), '  ', ' ') AS value, generate_subscripts(found, 1)::BIGINT AS start_no
FROM (SELECT doc_id, regexp_extract_all(
        ' ' || regexp_replace(text, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') || ' ',
        '(?i)[^\p{{L}}\p{{N}}_]({"|".join(sorted((name.replace(" ", "  ") for name in TOOLS), key=len, reverse=True))})[^\p{{L}}\p{{N}}_]', 1) AS found
      FROM documents)
"""


@query("indicators", _indicator_sql(I.PATTERNS))
def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.extract_indicators(T.document_messages(spark, sf_dir), key="doc_id")
    return found.withColumn("start_no", F.col("start_no").cast("bigint"))


def wrong_case(address: Column) -> Column:
    """An address of 0x and 40 hex digits with letters of a wrong case.

    All letters turn, except where they are of one case: turned, they would be so again, and such an address
    carries no checksum that could be wrong. There the first letter turns alone. Where it is the only one,
    no case is wrong, and the last digit becomes none.
    """
    digits = F.substring(address, 3, 40)
    turned = F.translate(digits, "abcdefABCDEF", "ABCDEFabcdef")
    one_case = (digits == F.lower(digits)) | (digits == F.upper(digits))
    first = F.length(F.regexp_extract(digits, "^([0-9]*)", 1)) + 1
    one_turned = F.overlay(digits, F.substring(turned, first, F.lit(1)), first)
    letters = F.length(F.translate(digits, "0123456789", ""))
    wrong = F.when(letters < 2, F.overlay(digits, F.lit("g"), F.lit(40))).when(one_case, one_turned).otherwise(turned)
    return F.concat(F.lit("0x"), wrong)


@query(
    "checked_addresses",
    """
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'eth' ELSE 'btc' END AS kind, 1::BIGINT AS start_no FROM documents WHERE doc_id % 5 <> 0
""",
)
def checked_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made from hashes of the documents; every fifth has a wrong character or case and must be refused."""
    seed = F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 40)
    place = F.col("doc_id") % 3
    # Each kind is made only of its own documents' hashes, as functions for workers see all rows they are given.
    of_kind = [F.when(place == k, seed) for k in (0, 1)]
    cased = mixed_case(F.when(~place.isin(0, 1), F.concat(F.lit("0x"), seed)))
    address = F.when(place == 0, base58check(F.concat(F.lit("00"), of_kind[0]))).when(place == 1, bech32(0, of_kind[1])).otherwise(cased)
    other = F.when(F.substring("address", 12, 1) == "q", "p").otherwise("q")
    wrong = F.when(F.col("doc_id") % 3 == 2, wrong_case(F.col("address"))).otherwise(F.overlay("address", other, 12))
    text = F.concat(F.lit("send it to "), F.when(F.col("doc_id") % 5 == 0, wrong).otherwise(F.col("address")), F.lit(", today"))
    documents = T.table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", "text")
    messages = with_computed(documents, {"address": address}).select("doc_id", text.alias("text"))
    found = I.extract_indicators(messages, key="doc_id", text="text", checked=True)
    return found.select("doc_id", "kind", F.col("start_no").cast("bigint").alias("start_no"))


_PHRASE = r"\p{L}+ \p{L}+ \p{L}+"


@query(
    "gazetteer_names",
    rf"""
WITH names AS (SELECT DISTINCT lower(regexp_extract(text, '{_PHRASE}')) AS name FROM benchmark),
p AS (
  SELECT '(?i)[^\p{{L}}\p{{N}}_](' || string_agg(replace(name, ' ', '  '), '|' ORDER BY length(name) DESC, name) || ')[^\p{{L}}\p{{N}}_]' AS pattern
  FROM names WHERE name <> '')
SELECT doc_id, lower(replace(unnest(found), '  ', ' ')) AS name, generate_subscripts(found, 1)::BIGINT AS place
FROM (SELECT doc_id, regexp_extract_all(' ' || regexp_replace(text, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') || ' ', pattern, 1) AS found FROM documents, p)
""",
)
def gazetteer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions, in documents, of the first three words of benchmark items, numbered in text order."""
    phrase = F.regexp_extract("text", _PHRASE, 0)
    names = T.table(spark, sf_dir, "benchmark").select(phrase.alias("name"), F.lit("phrase").alias("kind"))
    found = I.match_names(T.table(spark, sf_dir, "documents"), names, key="doc_id", text="text")
    mentions = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "name"))).alias("mentions"))
    rows = mentions.select("doc_id", F.posexplode("mentions").alias("place", "mention"))
    return rows.select("doc_id", F.col("mention.name").alias("name"), (F.col("place") + 1).cast("bigint").alias("place"))


@query("page_urls", _indicator_sql(I.PATTERNS, "pages", "page_id", "url || ' ' || html"))
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = T.table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit(" "), "html").alias("text"))
    found = I.extract_indicators(pages, key="page_id", text="text")
    return found.withColumn("start_no", F.col("start_no").cast("bigint"))


# The given texts hold no wallet addresses and no advisories, so each gets some made from its id.
_BUILT = """
SELECT doc_id, text || ' pay bc1q' || md5(doc_id::VARCHAR) || ' or 0x' || md5(doc_id::VARCHAR) || substr(md5('x' || doc_id), 1, 8)
  || ', see cve-2021-' || lpad((doc_id % 100000)::VARCHAR, 5, '0') || ' at https://a' || doc_id || '.example/x?y=1 .' AS text
FROM documents
"""


@query("built_indicators", _indicator_sql(I.PATTERNS, f"({_BUILT})"))
def built_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("doc_id").cast("string")
    built = F.concat(
        "text", F.lit(" pay bc1q"), F.md5(number), F.lit(" or 0x"), F.md5(number),
        F.substring(F.md5(F.concat(F.lit("x"), number)), 1, 8), F.lit(", see cve-2021-"),
        F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0"), F.lit(" at https://a"), number, F.lit(".example/x?y=1 ."),
    )
    documents = T.table(spark, sf_dir, "documents").select("doc_id", built.alias("text"))
    found = I.extract_indicators(documents, key="doc_id", text="text")
    return found.withColumn("start_no", F.col("start_no").cast("bigint"))


@query("tool_mentions", _TOOL_SQL)
def tool_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.extract_indicators(T.document_messages(spark, sf_dir), key="doc_id", patterns={}, tools=TOOLS)
    return found.withColumn("start_no", F.col("start_no").cast("bigint"))


# --- actors ------------------------------------------------------------------------------


def _persona_sql(table: str, actor: str, hours: str) -> str:
    def count(char_class: str) -> str:
        return rf"length(regexp_replace(text, '[^\p{{{char_class}}}]', '', 'g'))"

    return f"""
WITH m AS (SELECT {actor} AS actor, text, length(text) AS chars, {count("P")} AS p, {count("Lu")} AS u, {count("Nd")} AS d FROM {table}),
     w AS (SELECT actor, unnest({sql.tokens("text")}) AS word FROM m),
     r AS (SELECT actor, count(DISTINCT word) / count(*) AS ttr FROM w GROUP BY actor)
SELECT actor, count(*) AS messages, round(avg(chars), 6) AS mean_length, round(stddev(chars), 6) AS sd_length,
       round(sum(p) / sum(chars), 6) AS punctuation_share, round(sum(u) / sum(chars), 6) AS uppercase_share,
       round(sum(d) / sum(chars), 6) AS digit_share, {hours} AS active_hours, round(any_value(ttr), 6) AS type_token_ratio
FROM m LEFT JOIN r USING (actor) GROUP BY actor
"""


_PERSONA_SHARES = (
    "mean_length", "sd_length", "punctuation_share", "uppercase_share", "digit_share", "type_token_ratio",
)


@query("persona_profiles", _persona_sql("documents", "source", "0::BIGINT"))
def persona_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = A.persona_profiles(T.document_messages(spark, sf_dir), timestamp=None)
    return _rounded(profiles, *_PERSONA_SHARES).withColumn("active_hours", F.col("active_hours").cast("bigint"))


@query(
    "persona_profiles_timed",
    """
SELECT user_id AS actor, count(*) AS messages, round(avg(length(event_type)), 6) AS mean_length,
       count(DISTINCT hour(ts)) AS active_hours, round(count(DISTINCT event_type) / count(*), 6) AS type_token_ratio
FROM events GROUP BY user_id
""",
)
def persona_profiles_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = A.persona_profiles(T.event_messages(spark, sf_dir))
    return _rounded(profiles, "mean_length", "type_token_ratio").select(
        "actor", "messages", "mean_length", F.col("active_hours").cast("bigint").alias("active_hours"), "type_token_ratio"
    )


def _labelled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = T.table(spark, sf_dir, "conversations").withColumnRenamed("role", "actor")
    return C.fill_language(turns, text="text")


_LABELLED = f"SELECT conv_id, turn, role AS actor, {sql.language('text')} AS language FROM conversations"


@query(
    "language_mix",
    f"""
WITH c AS (SELECT actor, language, count(*) AS messages FROM ({_LABELLED}) GROUP BY ALL),
     s AS (SELECT *, messages / sum(messages) OVER (PARTITION BY actor) AS share FROM c)
SELECT actor, language, messages, round(share, 6) AS share,
       round(-sum(share * log2(share)) OVER (PARTITION BY actor), 6) + 0.0 AS entropy FROM s
""",
)
def language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = _rounded(A.language_mix(_labelled_turns(spark, sf_dir)), "share", "entropy")
    return mix.withColumn("entropy", F.col("entropy") + 0.0)


@query(
    "code_switches",
    f"""
WITH k AS (SELECT conv_id, language, lag(language) OVER (PARTITION BY conv_id ORDER BY turn) AS previous
           FROM ({_LABELLED}) WHERE language <> 'unknown')
SELECT conv_id AS conversation, count(*) AS messages, count(*) FILTER (previous <> language) AS switches FROM k GROUP BY conv_id
""",
)
def code_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.code_switches(
        _labelled_turns(spark, sf_dir), "conv_id", ["turn"], stretch=F.floor(F.col("turn") / 256)
    )


@query(
    "event_type_switches",
    """
WITH k AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
SELECT user_id AS conversation, count(*) AS messages, count(*) FILTER (previous <> event_type) AS switches FROM k GROUP BY user_id
""",
)
def event_type_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The same sequence operator over long, busy sequences cut into hours.
    return A.code_switches(
        T.event_messages(spark, sf_dir),
        "actor",
        ["timestamp", "message_id"],
        stretch=F.date_trunc("hour", "timestamp"),
        language="event_type",
    )


_HOURS = ", ".join(f"count(*) FILTER (hour(ts) = {h}) AS h{h:02d}" for h in range(24))
_SPANS = " UNION ALL ".join(
    f"SELECT actor, {start} AS start, {' + '.join(f'h{(start + step) % 24:02d}' for step in range(8))} AS n FROM c"
    for start in range(24)
)


@query(
    "activity_hours",
    f"""
WITH c AS (SELECT user_id AS actor, {_HOURS} FROM events GROUP BY user_id),
     q AS (SELECT actor, start, n, row_number() OVER (PARTITION BY actor ORDER BY n, start) AS rn FROM ({_SPANS}))
SELECT c.*, start::BIGINT AS quiet_start, n AS quiet_messages FROM c JOIN q USING (actor) WHERE rn = 1
""",
)
def activity_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = A.activity_hours(T.event_messages(spark, sf_dir))
    return hours.withColumn("quiet_start", F.col("quiet_start").cast("bigint"))


_EDGES = """
SELECT user_id AS sender, (props->>'k')::BIGINT AS recipient, count(*) AS messages, min(ts) AS first_seen, max(ts) AS last_seen
FROM events WHERE user_id IS NOT NULL AND props->>'k' IS NOT NULL GROUP BY ALL
"""


@query("edges", _EDGES)
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.edges(T.event_messages(spark, sf_dir))
    return found.withColumns({name: F.col(name).cast(NTZ) for name in ("first_seen", "last_seen")})


@query(
    "node_degrees",
    f"""
WITH e AS ({_EDGES}),
     n AS (SELECT sender AS node, 1 AS o, 0 AS i, messages AS s, 0 AS r FROM e UNION ALL SELECT recipient, 0, 1, 0, messages FROM e)
SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, sum(s)::BIGINT AS sent, sum(r)::BIGINT AS received
FROM n GROUP BY node
""",
)
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.node_degrees(A.edges(T.event_messages(spark, sf_dir)))


@query(
    "reciprocity",
    f"""
WITH e AS ({_EDGES})
SELECT least(sender, recipient) AS a, greatest(sender, recipient) AS b,
       sum(CASE WHEN sender < recipient THEN messages ELSE 0 END)::BIGINT AS a_to_b,
       sum(CASE WHEN sender > recipient THEN messages ELSE 0 END)::BIGINT AS b_to_a, count(*) = 2 AS reciprocal
FROM e WHERE sender <> recipient GROUP BY 1, 2
""",
)
def reciprocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.reciprocity(A.edges(T.event_messages(spark, sf_dir)))
