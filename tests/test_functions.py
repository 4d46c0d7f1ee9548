"""Edge rows of the column functions."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chatseam.functions import languages, text, timestamps, vectors


def apply(spark, values, expression, kind="string"):
    frame = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [row.r for row in frame.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()]


def test_clean_text(spark):
    cases = {
        "a  b\t c": "a b c",
        "a\r\nb\rc": "a\nb\nc",
        "a\n\n\n\nb\n\nc": "a\n\nb\n\nc",
        "\x1c  a　": "a",
        "a  b": "a  b",
        " \n\t ": "",
        None: None,
        "a \n b": "a \n b",
        "a\r\r\rb": "a\n\nb",
    }
    assert apply(spark, cases, text.clean_text) == list(cases.values())


def test_clean_text_matches_python(spark):
    import re

    def expected(value):
        value = value.replace("\r\n", "\n").replace("\r", "\n")
        value = re.sub(r"[ \t]+", " ", value)
        return re.sub(r"\n{3,}", "\n\n", value).strip()

    import itertools

    values = ["".join(p) for p in itertools.product("a \t\n\r", repeat=5)]
    assert apply(spark, values, text.clean_text) == [expected(v) for v in values]


def test_clean_body_keeps_newlines(spark):
    assert apply(spark, ["a\n\n\n\nb \t c"], lambda c: text.clean_text(c, collapse_newlines=False)) == ["a\n\n\n\nb c"]


def test_length_counts_code_points(spark):
    assert apply(spark, ["\U0001f600\U0001f600", "да"], lambda c: F.length(text.clean_text(c))) == [2, 2]


def test_tokens_and_bigrams(spark):
    got = apply(spark, ["The cat, the Кот_1 a x2", "one", "", None], lambda c: text.tokens(c, ["the"]))
    assert got == [["cat", "кот_1", "x2"], ["one"], [], None]
    got = apply(spark, ["b the c d", "one", ""], lambda c: text.with_bigrams(text.tokens(F.concat(c, F.lit("")), ["the"])))
    assert got == [[], ["one"], []]
    assert apply(spark, ["bb the cc dd"], lambda c: text.with_bigrams(text.tokens(c, ["the"]))) == [
        ["bb", "cc", "dd", "bb cc", "cc dd"]
    ]


def test_chunks_lose_nothing(spark):
    values = ["", "a", "ab", "abc", "abcdefg", "да\U0001f600xyz"]
    got = apply(spark, values, lambda c: text.chunks(c, 3))
    assert ["".join(parts) for parts in got] == values
    assert got[4] == ["abc", "def", "g"]


def test_timestamps(spark):
    noon = dt.datetime(2022, 2, 14, 12)
    cases = {
        "2022-02-14 12:00:00": noon, "2022-02-14T12:00:00Z": noon, "2022-02-14T15:00:00+03:00": noon,
        "2022-02-14 15:00:00 +0300": noon, "2022-02-14 12:00:00 UTC": noon, " 2022-02-14 12:00 ": noon,
        "2022/2/14 12:00:00": noon, "02/14/2022 12:00": noon, "14.02.2022 12:00:00": noon,
        "Mon, 14 Feb 2022 12:00:00 GMT": noon, "14 Feb 2022 15:00:00 +0300": noon,
        "1644840000": noon, "1644840000000": noon, "1.644840000e9": noon,
        "20220214": dt.datetime(2022, 2, 14), "2022": dt.datetime(2022, 1, 1), "Feb 14, 2022": dt.datetime(2022, 2, 14),
        "02/14/2022 12:00 PM": noon, "2022/02/14 12:00:00.000": noon, "14 February 2022 12:00": noon,
        "February 14, 2022 12:00": noon, "14 Feb 2022": dt.datetime(2022, 2, 14), "Mon Feb 14 12:00:00 2022": noon,
        "2022-02-14T12:00Z": noon, "2022-02-14 15:00 +0300": noon, "20220214T120000Z": noon, "14/02/2022 12:00": noon,
        "02-03-2022 12:00": dt.datetime(2022, 2, 3, 12), "1644840000000000": noon,
        "2022/02/14 12:00:00.25": noon.replace(microsecond=250_000),
        "32/02/2022 12:00": None, "30 February 2022": None,
        "2022-02-30": None, "12:00": None, "soon": None, "": None, "99999999999999999999": None, "NaN": None,
    }
    assert apply(spark, cases, timestamps.parse_timestamp) == list(cases.values())


def test_timestamps_of_other_programs(spark):
    day = dt.datetime(2021, 3, 1)
    ten, evening = day.replace(hour=10), day.replace(hour=22)
    cases = {
        "3/1/21 10:00": ten, "3/1/21": day, "3/1/21 10:00 PM": evening, "25/1/21 10:00": dt.datetime(2021, 1, 25, 10), "2021.03.01 10:00": ten, "2021.3.1": day,
        "2021-03-01 10:00:00,123": ten.replace(microsecond=123_000), "2021-03-01T10:00:00,5Z": ten.replace(microsecond=500_000),
        "2021-03-01 10:00 PM": evening, "2021-03-01 10:00:00pm": evening, "Mar 1 2021 10:00AM": ten, "Mar 1 2021 10:00": ten,
        "March 1, 2021 10:00 PM": evening, "Mar 1, 2021 12:30 AM": day.replace(minute=30), "Mon, Mar 1, 2021 10:00 pm": evening,
        "3/1/2021 10:00PM": evening, "2021-03-01 22:00 PM": None, "Mar 32 2021 10:00AM": None, "2021-03-01, later": None,
    }
    assert apply(spark, cases, timestamps.parse_timestamp) == list(cases.values())


def test_languages(spark):
    cases = {
        "это русский текст": "ru", "це український текст ї": "uk", "the cat is on the table": "en",
        "der hund und die katze": "de", "le chat et la souris": "fr", "el perro y los gatos": "es",
        "xyzzy 123": "unknown", "": "unknown", None: "unknown", "mostly latin letters да": "unknown",
        "the лист of the day": "en",
    }
    assert apply(spark, cases, languages.detect_language) == list(cases.values())


def test_language_reads_the_whole_text(spark):
    long = "xyzzy " * 200 + "the and of is"
    assert apply(spark, [long], languages.detect_language) == ["en"]


def test_vectors(spark):
    frame = spark.sql("select array(3f, 4f) a, array(4f, -3f) b, array(0f, 0f) z")
    row = frame.select(
        vectors.l2_normalize(F.col("a")).alias("n"), vectors.l2_normalize(F.col("z")).alias("nz"),
        vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.cosine(F.col("a"), F.col("z")).alias("cz"),
        vectors.dot(F.col("a"), F.col("a")).alias("d"),
    ).first()
    assert row.n == pytest.approx([0.6, 0.8]) and row.nz == [0.0, 0.0]
    assert row.c == pytest.approx(0.0) and row.cz is None and row.d == 25.0
