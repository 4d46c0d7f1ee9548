"""URL filters, neighbours, and every query and stage on the given tables."""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pytest
from check import connect, difference
from pyspark.sql import functions as F

from chatseam.llm import neighbours, urls
from chatseam.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
on_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


def test_urls(spark):
    pages = [
        (1, "HTTP://www.Example.COM/en/x?utm_source=a&b=2&a=1#f", "http://x"), (2, "https://example.com/en/x/?a=1&b=2", None), (3, "https://a.example.com/en/q", None),
        (4, "https://shop.net/es/1", None), (5, "https://shop.net/es", None), (6, "http://plain.org/p/", None), (7, "https://plain.org/p?ref=z", None),
        (8, None, None), (9, "no scheme", None), (10, "x://", None), (11, "https://plain.org/other", None), (None, "http://plain.org/p", None), (6, "http://plain.org/p/", None),
        (12, "http://c.com?x", None), (13, "http://notexample.org/" + "y" * 5000, None),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, host string")
    listed = spark.createDataFrame([("http://plain.org/p//#a",), ("https://plain.org/p",), (None,), ("junk",), ("http://shop.net/es",)], "url string")
    found = Counter(tuple(r) for r in urls.judge_urls(frame, listed).select("page_id", "host", "path", "rule", "verdict").collect())
    want = Counter([
        (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "example.com", "/en/x/", "example.com/en/", "block"),
        (3, "a.example.com", "/en/q", "example.com/en/", "block"), (4, "shop.net", "/es/1", "net/es/", "block"), (5, "shop.net", "/es", None, "block"),
        (6, "plain.org", "/p/", None, "block"), (6, "plain.org", "/p/", None, "block"), (7, "plain.org", "/p", None, "block"), (8, "", "", None, "allow"),
        (9, "", "", None, "allow"), (10, "", "", None, "allow"), (11, "plain.org", "/other", None, "allow"), (None, "plain.org", "/p", None, "block"),
        (12, "c.com", "", None, "allow"), (13, "notexample.org", "/" + "y" * 5000, None, "allow"),
    ])
    assert found == want
    assert urls.judge_urls(frame.where("false"), listed).count() == 0
    assert urls.judge_urls(frame, listed.where("false")).where("verdict = 'block'").count() == 3
    canonical = {r[0] for r in frame.where("page_id in (1, 2)").select(urls.canonical(F.col("url"))).collect()}
    assert canonical == {"example.com/en/x?a=1&b=2"}


def test_filter_has_no_false_negatives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("http://h.org/"), "id").alias("url"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/"), "id").alias("url"))
    for bits in (12, 1):
        blocked = urls.judge_urls(pages, listed, bits_a_url=bits).where("verdict = 'block'")
        assert (blocked.count(), blocked.agg(F.max("page_id")).first()[0]) == (3000, 2999)


def brute_nearest(rows, asks, k):
    out = []
    for q, v in rows:
        if asks(q):
            scored = sorted((-float(np.dot(v, w)), i) for i, w in rows if i != q)
            out += [(q, n + 1, i, round(-s, 9)) for n, (s, i) in enumerate(scored[:k])]
    return Counter(out)


def test_neighbours_exact_when_few(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in np.round(rng.normal(size=8), 3)]) for k in range(90)]
    rows += [(100 + k, rows[0][1]) for k in range(40)] + [(200, [2.5 * x for x in rows[1][1]])]
    bad = [(300, None), (301, [0.0] * 8), (302, [1.0] * 7 + [None]), (303, [float("nan")] + [1.0] * 7), (304, [float("inf")] + [1.0] * 7), (305, [1.0, 2.0])]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).repartition(4)
    found = neighbours.nearest(frame, F.col("vec_id") % 20 == 0, k=20).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found) == brute_nearest(rows, lambda q: q % 20 == 0, 20)
    assert neighbours.nearest(frame.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    few = neighbours.nearest(frame.where("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert [r.rank for r in few] == [1, 2, 3, 4]


def test_neighbours_of_every_length_and_null_ids(spark):
    rng = np.random.default_rng(9)
    rows = [(k, [float(x) for x in np.round(rng.normal(size=8 if k % 3 else 5), 3)]) for k in range(700)]
    frame = spark.createDataFrame([*rows, (None, rows[0][1]), (None, rows[1][1]), (None, None)], "vec_id long, embedding array<double>").repartition(3)
    found = neighbours.nearest(frame, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(True)), k=7).collect()
    want = Counter()
    for size in (5, 8):
        want += brute_nearest([r for r in rows if len(r[1]) == size], lambda q: q % 20 == 0, 7)
    assert Counter((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found) == want


@on_tables
def test_neighbours_recall(spark):
    path = SF_DIR.replace("sf0.001", "sf0.1")
    vectors = spark.read.parquet(f"{path if os.path.isdir(path) else SF_DIR}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in vectors.collect()]
    matrix, ids = np.stack([v for _, v in rows]), np.array([i for i, _ in rows])
    hits = total = 0
    found = {}
    for r in neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, least=200).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for n in np.flatnonzero(ids % 20 == 0):
        scores = matrix @ matrix[n]
        scores[n] = -np.inf
        hits += len(found[ids[n]] & set(ids[np.lexsort((ids, -scores))][:20].tolist()))
        total += 20
    assert hits / total >= 0.9


@on_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) is None


@on_tables
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        if name == "pieces":
            assert out.count() == docs.count() and out.where("not round_trip").count() == 0
            continue
        assert out.columns == columns
        docs = out.cache()
        n = docs.count()
        assert 0 < n and (name == "mixing" or n <= before)
        before = n
    assert corpus_pipeline.run(spark, SF_DIR).count() == before
    empty = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_DIR).count() == 0


@on_tables
def test_every_operator_has_a_query():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 11))
