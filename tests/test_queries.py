"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest
from check import connect, difference

from chatseam.plans import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, connection, name):
    assert difference(QUERIES[name](spark, SF_DIR), connection, ORACLES[name]) is None


def test_queries_without_sql_return_one_row_per_input(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    vectors = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").count()
    expected = {"hashed_tfidf": documents, "reduced_vectors": vectors, "clusters": vectors, "density_clusters": vectors}
    for name, rows in expected.items():
        assert QUERIES[name](spark, SF_DIR).count() == rows
    assert set(QUERIES) - set(ORACLES) == set(expected)


def test_entry_point():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == [
        "message_id", "dataset", "actor", "timestamp", "language", "raw_text", "source_file", "metadata",
    ]
