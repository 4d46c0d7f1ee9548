from __future__ import annotations

import random

import pytest

WORDS = "amber birch cedar delta ember fjord grove heath inlet jetty knoll larch marsh north ochre pines quartz ridge slate thorn".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls in every column, empty and long texts, ties, repeated rows."""
    line = "This very line stands in several documents."
    texts = [prose(k, 40 + 7 * k) for k in range(12)]
    found = [(k, text + "\n" + (line if k % 3 == 0 else "own line " + str(k)), "en" if k % 2 else "fr", f"s{k % 4}", k) for k, text in enumerate(texts)]
    found += [
        (20, None, "en", "s1", 1), (21, "", "en", "s1", 1), (22, " \n\t\x0b\n", None, "s1", None), (23, prose(23, 60), None, None, 5),
        (None, prose(24, 50) + "\n" + line, "en", None, 3), (None, prose(25, 50), "fr", "s0", 3), (None, None, None, None, None),
        (26, texts[3] + "\n" + line, "en", "s3", 9), (26, texts[3] + "\n" + line, "en", "s3", 9), (27, texts[3] + "\n" + line, "en", "s3", 9),
        (28, prose(28, 30_000), "en", "s2", 7), (29, "x" * 30_000, "en", "s2", 7), (30, "é▁ü\u2581 ▁ \U0001f600x \x00y\r\n" * 3, "de", "s9", 2),
        (31, (line + "\n") * 3 + "  " + line.upper() + "\t\n" + "short", "de", "s9", 2),
    ]
    return found


@pytest.fixture(scope="session")
def documents(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(documents):
    """The same with extra columns named like the operators' own ones."""
    from pyspark.sql import functions as F

    names = ["_id", "_text_id", "_size", "_key", "_source", "_taken", "_keep", "_kept", "_features", "_place", "_class", "id", "key", "size", "fp", "first", "kept"]
    return documents.select("*", *(F.lit(name).alias(name) for name in names))


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.where("false")
