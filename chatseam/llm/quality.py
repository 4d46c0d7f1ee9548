"""Quality rules with thresholds that follow the data.

What is normal differs by language and source, so no fixed cutoff fits all. Each measure gets a
quantile sketch per language and source: counts of log-spaced buckets (relative error 1 %), which
merge by addition, give the same result in any order and have a bounded number of rows a group.
Fences around the middle half of a group are its thresholds; a join applies them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatseam.llm.common import carried, restored, small_batches, stored, table
from chatseam.llm.registry import query

GAMMA = 1.02
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

# Measures: how far beyond the middle half, in its widths, and how much further still, a document may lie.
# Widths are twice those of Tukey's outer fence (3). Where the middle half is one value the slack decides alone:
# for shares of lines and words it is two thirds of the base rule's 30 %, so that their fences can reject too.
MEASURES = {"symbols": (6.0, 0.1), "dup_lines": (6.0, 0.2), "repeats": (6.0, 0.2), "word_length": (6.0, 1.0)}
TWO_SIDED = ("word_length",)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a run of ``width`` words which occurs twice or more."""
    n = len(words)
    if n <= width:
        return 0
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    runs = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - width + 1 + k]
    order = np.argsort(runs)
    same = runs[order[1:]] == runs[order[:-1]]
    if not same.any():
        return 0
    starts = np.union1d(order[1:][same], order[:-1][same])
    cover = np.zeros(n + 1, dtype=np.int64)
    cover[starts] += 1
    cover[starts + width] -= 1
    return int((np.cumsum(cover) > 0).sum())


def measure(data: bytes | None) -> tuple[int, ...]:
    """The values of FEATURES of one text."""
    data = data or b""
    words = data.split()
    word_bytes = sum(map(len, words))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(data.decode()) - (len(data) - word_bytes),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def _features(text: pa.Array) -> pa.Array:
    rows = np.array([measure(data) for data in text.to_pylist()], dtype=np.int64).reshape(-1, len(FEATURES))
    return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(FEATURES))], list(FEATURES))


def with_features(documents: DataFrame, into: str = "_features") -> DataFrame:
    small_batches(documents.sparkSession)
    kind = "struct<" + ", ".join(f"{name}: bigint" for name in FEATURES) + ">"
    return documents.withColumn(into, F.arrow_udf(_features, kind)(F.col("text").cast("binary")))


def base_failed(features: str = "_features") -> Column:
    words, repeats = F.col(f"{features}.n_words"), F.col(f"{features}.n_repeat_words")
    return (words < 20) | (repeats * 100 > words * 30)


def _measures() -> Column:
    f = "_features."
    words, lines = F.greatest(F.col(f + "n_words"), F.lit(1)), F.greatest(F.col(f + "n_lines"), F.lit(1))
    values = {
        "symbols": F.col(f + "n_symbols") / words,
        "dup_lines": F.col(f + "n_dup_lines") / lines,
        "repeats": F.col(f + "n_repeat_words") / words,
        "word_length": F.col(f + "word_chars") / words,
    }
    return F.struct(*(values[name].alias(name) for name in MEASURES))


def _name(column: str) -> Column:
    return F.when(F.col(column).isNull(), "1").otherwise(F.concat(F.lit("0"), column))


def sketches(rows: DataFrame) -> DataFrame:
    """``_lang, _source, measure, bucket, n`` over rows with ``_lang, _source, _measures``; bucket null holds zeros."""
    each = F.explode(
        F.array(*(F.struct(F.lit(m).alias("measure"), F.col(f"_measures.{m}").alias("value")) for m in MEASURES))
    )
    return (
        rows.select("_lang", "_source", each.alias("m"))
        .select(
            "_lang", "_source", "m.measure",
            F.when(F.col("m.value") > 0, F.ceil(F.ln("m.value") / math.log(GAMMA))).cast("int").alias("bucket"),
        )
        .groupBy("_lang", "_source", "measure", "bucket")
        .agg(F.count("*").alias("n"))
    )


def fences(sketch: DataFrame, *group: str) -> DataFrame:
    """``group, _n`` and a pair of fences for each measure; sketches of several sources merge by adding counts."""
    merged = sketch.groupBy(*group, "measure", "bucket").agg(F.sum("n").alias("n"))
    in_order = Window.partitionBy(*group, "measure").orderBy(F.asc_nulls_first("bucket"))
    whole = Window.partitionBy(*group, "measure")
    value = F.coalesce(F.lit(2.0) * F.pow(F.lit(GAMMA), F.col("bucket")) / F.lit(GAMMA + 1), F.lit(0.0))
    counted = merged.withColumns(
        {"_upto": F.sum("n").over(in_order), "_n": F.sum("n").over(whole), "_value": value}
    )
    quartiles = counted.groupBy(*group, "measure").agg(
        F.max("_n").alias("_n"),
        *(F.min(F.when(F.col("_upto") >= F.col("_n") * q, F.col("_value"))).alias(name) for q, name in ((0.25, "_q1"), (0.75, "_q3"))),
    )
    columns = []
    for name, (widths, slack) in MEASURES.items():
        of = F.col("measure") == name
        reach = (F.col("_q3") - F.col("_q1")) * widths + slack
        low = F.col("_q1") - reach if name in TWO_SIDED else F.lit(-1.0)
        columns += [F.max(F.when(of, low)).alias(f"_low_{name}"), F.max(F.when(of, F.col("_q3") + reach)).alias(f"_high_{name}")]
    return quartiles.groupBy(*group).agg(F.max("_n").alias("_n"), *columns)


def judge(measured: DataFrame, min_group: int = 100, most_groups: int = 100_000) -> DataFrame:
    """Add ``_base_failed`` and ``_kept`` to rows with ``lang, source, _features``.

    Groups of fewer than ``min_group`` documents use the merged sketch of their language. The table
    of fences has one row a group; up to ``most_groups`` rows are broadcast, more are joined by
    shuffle. ``measured`` is read twice, so it should be stored.
    """
    rows = measured.withColumns(
        {"_lang": _name("lang"), "_source": _name("source"), "_base_failed": base_failed(), "_measures": _measures()}
    )
    sketch = stored(sketches(rows.where(~F.col("_base_failed"))))
    own = fences(sketch, "_lang", "_source").where(F.col("_n") >= min_group)
    merged = fences(sketch, "_lang").withColumn("_source", F.lit(None).cast("string"))
    table_ = stored(own.unionByName(merged))
    few = table_.count() <= most_groups
    result = rows
    bounds = [c for c in table_.columns if c.startswith(("_low_", "_high_"))]
    for level, keys in (("a", ["_lang", "_source"]), ("b", ["_lang"])):
        side = table_.where(F.col("_source").isNotNull() if level == "a" else F.col("_source").isNull())
        side = side.select(*keys, F.struct(*bounds).alias(f"_bounds_{level}"))
        result = result.join(F.broadcast(side) if few else side, keys, "left")
    result = result.withColumn("_bounds", F.coalesce("_bounds_a", "_bounds_b"))
    inside = F.lit(True)
    for name in MEASURES:
        inside &= F.col(f"_measures.{name}").between(F.col(f"_bounds._low_{name}"), F.col(f"_bounds._high_{name}"))
    return result.withColumn("_kept", ~F.col("_base_failed") & F.coalesce(inside, F.lit(True)))


def filter_quality(documents: DataFrame) -> DataFrame:
    """The documents that pass, unchanged.

    Null and empty texts have no words and fail the base rules; so does text that mostly repeats
    itself. Null languages and sources are groups of their own. Repeated rows are judged alike.
    Texts are measured whole and once: texts and measures are stored together. An empty table passes nothing.
    """
    measured = stored(with_features(carried(documents, "lang", "source")))
    return judge(measured).where("_kept").select(*restored(documents.columns))


_BUCKET = f"CASE WHEN value > 0 THEN ceil(ln(value) / {math.log(GAMMA)!r})::INT END"


def _fence_sql(group: str) -> str:
    cases = []
    for name, (widths, slack) in MEASURES.items():
        reach = f"((q3 - q1) * {widths} + {slack})"
        low = f"q1 - {reach}" if name in TWO_SIDED else "-1"
        cases += [f"max(CASE WHEN measure = '{name}' THEN {low} END) AS low_{name}", f"max(CASE WHEN measure = '{name}' THEN q3 + {reach} END) AS high_{name}"]
    return f"""
      SELECT {group}, max(n) AS n, {", ".join(cases)} FROM (
        SELECT {group}, measure, max(n) AS n, min(CASE WHEN upto >= n * 0.25 THEN v END) AS q1, min(CASE WHEN upto >= n * 0.75 THEN v END) AS q3
        FROM (SELECT {group}, measure, coalesce(2.0 * pow({GAMMA}, bucket) / {GAMMA + 1!r}, 0.0) AS v,
                     sum(c) OVER (PARTITION BY {group}, measure ORDER BY bucket NULLS FIRST) AS upto,
                     sum(c) OVER (PARTITION BY {group}, measure) AS n
              FROM (SELECT {group}, measure, bucket, count(*) AS c FROM sketch GROUP BY ALL))
        GROUP BY {group}, measure) GROUP BY {group}"""


@query(
    "op2_quality",
    rf"""
    WITH base AS (SELECT doc_id, lang, source, coalesce(text, '') AS t,
                         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
              FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM base)
              WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    runs AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 8], ' ') AS run
             FROM (SELECT doc_id, ws, unnest(range(len(ws) - 7)) AS i FROM base)),
    again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS c FROM runs) WHERE c > 1),
    covered AS (SELECT doc_id, sum(reach) AS n_repeat_words FROM (
                  SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS reach FROM again)
                GROUP BY doc_id),
    features AS (
      SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             coalesce(n_lines, 0) AS n_lines
      FROM base LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
    rated AS (
      SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             n_symbols / greatest(n_words, 1) AS symbols, n_dup_lines / greatest(n_lines, 1) AS dup_lines,
             n_repeat_words / greatest(n_words, 1) AS repeats, word_chars / greatest(n_words, 1) AS word_length
      FROM features),
    sketch AS (SELECT lang, source, measure, {_BUCKET} AS bucket
               FROM (UNPIVOT (SELECT lang, source, symbols, dup_lines, repeats, word_length FROM rated WHERE NOT base_failed)
                     ON symbols, dup_lines, repeats, word_length INTO NAME measure VALUE value)),
    own AS ({_fence_sql("lang, source")}),
    merged AS ({_fence_sql("lang")})
    SELECT r.doc_id, n_words, word_chars, n_symbols, r.n_dup_lines, r.n_repeat_words, base_failed,
           NOT base_failed AND {" AND ".join(
               f"coalesce(r.{m} BETWEEN CASE WHEN o.n >= 100 THEN o.low_{m} ELSE g.low_{m} END AND CASE WHEN o.n >= 100 THEN o.high_{m} ELSE g.high_{m} END, true)"
               for m in MEASURES)} AS kept
    FROM rated r LEFT JOIN own o ON r.lang IS NOT DISTINCT FROM o.lang AND r.source IS NOT DISTINCT FROM o.source
         LEFT JOIN merged g ON r.lang IS NOT DISTINCT FROM g.lang
    """,
)
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    judged = judge(stored(with_features(documents).drop("text")))
    return judged.select(
        "doc_id", *(F.col(f"_features.{name}").alias(name) for name in FEATURES[:-1]),
        F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"),
    )
