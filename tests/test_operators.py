"""Operators against brute force on small rows, skewed ones included."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatseam.operators import actors, clean, explore, indicators, sampling, search, similarity, summary, terms
from chatseam.schema import decode_metadata
from chatseam.sources import parquet
from chatseam.specs import get_spec, load_specs


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(5)


# --- duplicates and samples --------------------------------------------------------


def test_keep_first_with_a_hot_key_and_null_keys(spark):
    rows = [("hot" if i % 3 else (None if i % 2 else f"k{i}"), i) for i in range(600)]
    kept = clean.keep_first(frame(spark, rows, "k string, at int"), ["k"], ["at"]).collect()
    assert Counter(r.k for r in kept)["hot"] == 1
    assert {r.at for r in kept if r.k == "hot"} == {1}
    assert sum(r.k is None for r in kept) == sum(k is None for k, _ in rows)
    assert len(kept) == 1 + len({k for k, _ in rows if k and k != "hot"}) + sum(k is None for k, _ in rows)


def test_keep_first_limits_copies_before_the_shuffle(spark):
    plan = clean.keep_first(frame(spark, [("a", 1)], "k string, at int"), ["k"], ["at"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text.split("Exchange hashpartitioning(k", 1)[1]


def test_exploration_dedup_picks_its_rule_from_the_data(spark):
    schema = "msg_id string, body string, at int"
    with_ids = frame(spark, [("1", "a", 0), ("1", "b", 1), (None, "c", 2), (None, "c", 3)], schema)
    got = clean.exploration_dedup(with_ids, ["at"]).orderBy("at").collect()
    assert [r.at for r in got] == [0, 2, 3]
    without = frame(spark, [(None, "a", 0), (None, "a", 1), (None, "b", 2)], schema)
    assert [r.at for r in clean.exploration_dedup(without, ["at"]).orderBy("at").collect()] == [0, 2]


@pytest.mark.parametrize("groups", [None, ("hot", "small")])
def test_capped_sample_is_exact_and_repeatable(spark, groups):
    rows = [("hot", i) for i in range(400)] + [("small", i) for i in range(400, 407)] + [("mid", i) for i in range(500, 550)]
    rows += [(None, i) for i in range(600, 640)]
    expected = set()
    for group in ("hot", "small", "mid", None) if groups is None else groups:
        keys = [k for g, k in rows if g == group]
        expected |= set(sorted(keys, key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())[:30])
    for parts in (1, 16):
        data = spark.createDataFrame(rows, "g string, k int").repartition(parts)
        got = [r.k for r in sampling.capped_sample(data, "g", "k", 30, groups=groups).collect()]
        assert len(got) == len(set(got)) and set(got) == expected


def test_hot_term_is_split_without_broadcast(spark):
    rows = [(f"m{i}", "everywhere " + ("often" if i % 3 else "once%d" % i)) for i in range(600)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = terms.vocabulary_counts(frame(spark, rows, "id string, raw_text string"), "id", min_df=5, bigrams=False)
        assert kept.groupBy("term").count().orderBy("term").collect() == [("everywhere", 600), ("often", 400)]
        joined = next(line for line in kept._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin" in line)
        assert "_salt" in joined
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# --- distributions ---------------------------------------------------------------


def test_gaps_are_filled(spark):
    days = ["2024-01-01", "2024-01-01", "2024-01-04", "2024-01-05"]
    rows = [(dt.datetime.fromisoformat(d), "x") for d in days] + [(None, "x"), (dt.datetime(2024, 1, 2), None)]
    got = explore.daily_volume(frame(spark, rows, "timestamp timestamp, raw_text string")).collect()
    assert [(str(r.day), r.messages) for r in got] == [
        ("2024-01-01", 2), ("2024-01-02", 0), ("2024-01-03", 0), ("2024-01-04", 1), ("2024-01-05", 1),
    ]


def test_weeks_are_named_by_their_sunday(spark):
    rows = [("2024-01-01", "en"), ("2024-01-07", "en"), ("2024-01-08", "ru"), ("2024-01-29", "ru"), ("2024-01-29", "de")]
    data = frame(spark, [(dt.datetime.fromisoformat(d), lang, "x") for d, lang in rows], "timestamp timestamp, language string, raw_text string")
    got = [(r.language, str(r.week), r.messages) for r in explore.weekly_volume(data).collect()]
    assert got == [("en", "2024-01-07", 2), ("ru", "2024-01-14", 1), ("ru", "2024-01-21", 0), ("ru", "2024-01-28", 0), ("ru", "2024-02-04", 1)]


def test_histogram_matches_numpy(spark):
    rng = random.Random(3)
    values = [rng.randint(5, 2000) for _ in range(500)] + [1000, 5]
    got = explore.length_histogram(frame(spark, [(v,) for v in values], "body_len int"), bins=60).collect()
    counts, edges = np.histogram(np.clip(values, None, 1000), bins=60)
    assert [r.messages for r in got] == counts.tolist()
    assert [r.bin_start for r in got] == pytest.approx(edges[:-1]) and got[-1].bin_end == pytest.approx(edges[-1])
    single = explore.length_histogram(frame(spark, [(7,), (7,)], "body_len int"), bins=4).collect()
    assert [r.messages for r in single] == np.histogram([7, 7], bins=4)[0].tolist()
    assert explore.length_histogram(frame(spark, [(7,)], "body_len int").where("false")).count() == 0


@pytest.mark.parametrize("kind", ["uniform", "hot", "tiny", "two"])
def test_quantiles_match_numpy(spark, kind):
    rng = random.Random(1)
    values = {
        "uniform": [rng.randint(-10**9, 10**9) for _ in range(20000)],
        "hot": [7] * 4000 + [rng.randint(0, 100) for _ in range(5000)],
        "tiny": [3],
        "two": [1, 10],
    }[kind]
    probabilities = (0.25, 0.5, 0.75)
    data = frame(spark, [(v,) for v in values] + [(None,)], "v bigint")
    row = explore.exact_quantiles(data, "v", probabilities).first()
    assert list(row) == pytest.approx(np.quantile(values, probabilities).tolist())


def test_describe_of_nothing(spark):
    row = explore.describe(frame(spark, [(1,)], "v int").where("v > 5"), "v").first()
    assert row["count"] == 0 and row["mean"] is None and row["q50"] is None


def test_catalog(spark):
    rows = summary.catalog(spark, load_specs({"conti": {"enabled": True}, "mine": {}})).collect()
    assert [r.name for r in rows] == sorted(["babuk", "black_basta", "conti", "custom", "hack_forums", "lockbit", "mine"])
    by_name = {r.name: r for r in rows}
    assert by_name["conti"].enabled and by_name["conti"].display_name == get_spec("conti").display_name
    assert not by_name["babuk"].enabled and by_name["babuk"].display_name == "babuk"


def test_drop_rate(spark):
    row = spark.sql("select 100 a, 80 b, 0 z").select(
        summary.drop_rate(F.col("b"), F.col("a")).alias("r"), summary.drop_rate(F.col("z"), F.col("z")).alias("n")
    ).first()
    assert (row.r, row.n) == (0.2, 0.0)


# --- terms, topics, search ------------------------------------------------------------

TEXTS = [
    (1, "a", "red fox red fox jumps"), (2, "a", "red dog sleeps"), (3, "b", "blue fish swims the sea"),
    (4, "b", "blue sea blue sky"), (5, "b", "the red sea"), (6, None, "red herring"),
]


def texts(spark):
    return frame(spark, TEXTS, "id int, topic string, raw_text string")


def python_terms(text, stop=("the",)):
    words = [w for w in text.split() if len(w) > 1 and w not in stop]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_vocabulary_and_counts(spark):
    df = Counter(t for _, _, text in TEXTS for t in set(python_terms(text)))
    got = {r.term: r.documents for r in terms.document_frequencies(texts(spark), min_df=2, stop_words=["the"]).collect()}
    assert got == {t: n for t, n in df.items() if n >= 2}
    counts = {(r.id, r.term): r.n for r in terms.vocabulary_counts(texts(spark), "id", min_df=2, stop_words=["the"]).collect()}
    assert counts == {(i, t): n for i, _, text in TEXTS for t, n in Counter(python_terms(text)).items() if df[t] >= 2}


def test_class_weights(spark):
    per_topic = {}
    for _, topic, text in TEXTS:
        if topic:
            per_topic.setdefault(topic, Counter()).update(python_terms(text))
    everywhere = sum(per_topic.values(), Counter())
    average = sum(everywhere.values()) / len(per_topic)
    got = {(r.topic, r.term): r.weight for r in terms.class_term_weights(texts(spark), "topic", stop_words=["the"]).collect()}
    for topic, counts in per_topic.items():
        for term, n in counts.items():
            expected = n / sum(counts.values()) * math.log(1 + average / everywhere[term])
            assert got[topic, term] == pytest.approx(expected)
    assert len(got) == sum(len(c) for c in per_topic.values())


def test_topic_info_leaves_outliers_out(spark):
    rows = [(i, -1 if i < 3 else i % 2, f"word{i % 2} common text") for i in range(10)]
    data = frame(spark, rows, "id int, topic int, raw_text string")
    keywords = terms.topic_keywords(terms.class_term_weights(data, "topic", bigrams=False), top=2)
    info = terms.topic_info(data, keywords, "topic").collect()
    assert {r.topic for r in info} == {0, 1} and [r["count"] for r in info] == [4, 3]
    assert info[0].name.startswith("1_word1")


def test_bm25_matches_the_formula(spark):
    queries = {"q": "red sea red", "none": "zebra"}
    docs = {i: [w for w in text.split() if len(w) > 1] for i, _, text in TEXTS}
    mean = sum(map(len, docs.values())) / len(docs)
    expected = {}
    for i, words in docs.items():
        score = 0.0
        for term in ("red", "sea", "red"):
            df = sum(term in w for w in docs.values())
            tf = words.count(term)
            score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / mean))
        if score:
            expected[i] = score
    got = {r.id: r.score for r in search.bm25_scores(texts(spark), queries, key="id").collect()}
    assert got == pytest.approx(expected)
    best = search.bm25_search(texts(spark), queries, k=2, key="id").orderBy("rank").collect()
    assert [r.id for r in best] == sorted(expected, key=lambda i: (-expected[i], i))[:2]
    with pytest.raises(ValueError):
        search.bm25_scores(texts(spark), {"q": "!"})


def test_hybrid_weights(spark):
    text = frame(spark, [(1, 2.0), (2, 4.0), (3, 3.0)], "id int, score double")
    vector = frame(spark, [(2, 0.1), (3, 0.9), (4, 0.5)], "id int, score double")
    rank = lambda w: [r.id for r in search.hybrid_search(text, vector, "id", vector_weight=w).collect()]
    assert rank(1.0) == [3, 4, 1, 2]
    assert rank(0.0) == [2, 3, 1, 4]
    assert [round(r.score, 6) for r in search.hybrid_search(text, vector, "id").collect()] == [0.85, 0.35, 0.3, 0.0]


# --- vectors ---------------------------------------------------------------------------


def random_vectors(spark, n, dims, seed, name):
    rng = np.random.default_rng(seed)
    matrix = rng.normal(size=(n, dims))
    return matrix, frame(spark, [(i, [float(x) for x in row]) for i, row in enumerate(matrix)], f"{name} int, embedding array<double>")


@pytest.mark.parametrize("values_per_block", [10**6, 40])
def test_nearest_targets_match_numpy_in_one_block_and_in_many(spark, monkeypatch, values_per_block):
    monkeypatch.setattr(similarity, "MAX_TARGET_VALUES", values_per_block)
    a, vectors = random_vectors(spark, 40, 8, 1, "id")
    b, targets = random_vectors(spark, 15, 8, 2, "target")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = unit(a) @ unit(b).T
    expected = {}
    for i, row in enumerate(scores):
        order = sorted(range(15), key=lambda t: (-row[t], t))[:3]
        for place, t in enumerate(t for t in order if row[t] >= 0.3):
            expected[i, t] = place + 1
    found = similarity.nearest_targets(vectors, targets, "id", "target", threshold=0.3)
    assert {(r.id, r.target): r["rank"] for r in found.collect()} == expected


def test_nearest_targets_without_targets(spark):
    _, vectors = random_vectors(spark, 3, 4, 1, "id")
    _, targets = random_vectors(spark, 3, 4, 1, "target")
    assert similarity.nearest_targets(vectors, targets.where("false"), "id", "target").count() == 0


def test_centroids(spark):
    data = frame(spark, [("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", [5.0, 5.0])], "g string, embedding array<double>")
    assert {r.g: r.embedding for r in similarity.centroids(data, "g").collect()} == {"a": [2.0, 4.0], "b": [5.0, 5.0]}


def test_clusters_separate_blobs_and_mark_small_ones(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(loc=(0 if i < 60 else 50), scale=0.1, size=3)]) for i in range(110)]
    rows += [(1000 + i, [-80.0, 80.0, float(i)]) for i in range(4)]
    got = {r.id: r.topic for r in similarity.cluster(frame(spark, rows, "id int, embedding array<double>"), k=3, min_cluster_size=30).collect()}
    assert len(got) == 114
    assert {got[1000 + i] for i in range(4)} == {-1}
    assert len({got[i] for i in range(60)}) == 1 and len({got[i] for i in range(60, 110)}) == 1 and got[0] != got[60]


def test_hashed_tfidf_vectors_have_unit_length(spark):
    from pyspark.ml.functions import vector_to_array

    rows = similarity.hashed_tfidf(texts(spark), dimensions=64).select(vector_to_array("features").alias("v")).collect()
    assert all(np.linalg.norm(r.v) == pytest.approx(1.0) for r in rows)


def test_user_encoder(spark):
    got = similarity.embed(texts(spark), lambda text: F.array(F.length(text).cast("float")))
    assert {r.embedding[0] for r in got.collect()} == {float(len(t)) for _, _, t in TEXTS}


# --- indicators ---------------------------------------------------------------------------


def test_indicators(spark):
    btc, eth = "1" + "A" * 30, "0x" + "aB" * 20
    text = (f"mail a.b@x.org and c@d.example, go https://x.org/a?b=1 at 10.0.0.255 not 300.1.1.1 ; pay {btc} or {eth} "
            "see cve-2021-44228, CVE-2020-0601; with Cobalt Strike and mimikatz, önmimikatz")
    data = frame(spark, [(1, text), (2, "nothing here"), (3, None)], "id int, raw_text string")
    got = indicators.extract_indicators(data, key="id", tools=("cobalt strike", "mimikatz")).collect()
    found = {}
    for r in sorted(got, key=lambda r: r.start_no):
        found.setdefault(r.kind, []).append(r.value)
    assert {r.id for r in got} == {1}
    assert found == {
        "email": ["a.b@x.org", "c@d.example"], "url": ["https://x.org/a?b=1"], "ipv4": ["10.0.0.255"], "btc": [btc], "eth": [eth],
        "cve": ["cve-2021-44228", "CVE-2020-0601"], "tool": ["Cobalt Strike", "mimikatz"],
    }


def test_wrong_checksums_are_refused(spark):
    good = ["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4", "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed", "0x" + "ab" * 20]
    bad = ["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5", "0x5AAeb6053F3E94C9b9A09f33669435E7Ef1BeAed"]
    data = frame(spark, [(1, " ".join(good)), (2, " ".join(bad) + " a@b.org"), (3, None)], "id int, raw_text string")
    got = indicators.extract_indicators(data, key="id", checked=True).collect()
    assert sorted((r.id, r.value) for r in got) == sorted([(1, a) for a in good] + [(2, "a@b.org")])


def brute_names(text, names):
    out, at, low = [], 0, text.lower()
    word = lambda k: 0 <= k < len(text) and (text[k].isalnum() or text[k] == "_")
    while at < len(text):
        here = [n for n in names if low.startswith(n, at) and not word(at - 1) and not word(at + len(n))]
        if here:
            best = max(here, key=len)
            out.append((best, at, at + len(best)))
            at += len(best)
        else:
            at += 1
    return out


def test_names_of_a_large_gazetteer(spark):
    parts = ["ab", "ba", "a", "b", "é", "x_1", "ß"]
    names = {f"{p} {q}" for p in parts for q in parts} | set(parts) | {f"{p}-{q} {r}" for p in parts for q in parts for r in parts}
    rare = [f"name {k} of many" for k in range(100_000)]
    rows = [("a b ba  Ab-É A,ba x_1", 1), ("AB ab abab b a-b a-b ba", 2), (None, 3), ("", 4), ("name 77 of many; NAME 99999 OF MANY, name 100000 of many", 5), ("İ ab ẞ ba", 6), ("only ab.", 7)]
    listed = spark.createDataFrame([(n, "part") for n in names] + [(n, "rare") for n in rare] + [("ab", "also"), (" ", "x"), (None, "y")], "name string, kind string")
    got = indicators.match_names(frame(spark, rows, "t string, id int"), listed, key="id", text="t").collect()
    want = {(i, n, s, e) for t, i in rows if t and i != 6 for n, s, e in brute_names(t, [*names, "name 77 of many", "name 99999 of many"])}
    assert {(r.id, r.name, r.start, r.end) for r in got if r.id != 6} == want
    assert [(r.name, r.value, r.start) for r in got if r.id == 6 and r.kind != "also"] == [("ab ß", "ab ẞ", 2), ("ba", "ba", 7)]
    assert {r.kind for r in got if r.name == "ab"} == {"part", "also"}
    with pytest.raises(ValueError, match="names"):
        indicators.match_names(frame(spark, rows, "t string, id int"), listed, key="id", text="t", most=10)
    assert indicators.match_names(frame(spark, rows, "t string, id int"), listed.where("false"), key="id", text="t").count() == 0


# --- actors --------------------------------------------------------------------------------


def test_persona_profile(spark):
    at = dt.datetime(2024, 1, 1, 5)
    rows = [("ann", "Hello, WORLD 12", at), ("ann", "hello again!", at.replace(hour=23)), ("bob", "x", None)]
    got = {r.actor: r for r in actors.persona_profiles(frame(spark, rows, "actor string, raw_text string, timestamp timestamp")).collect()}
    ann = got["ann"]
    chars = len(rows[0][1]) + len(rows[1][1])
    assert (ann.messages, ann.active_hours) == (2, 2)
    assert ann.uppercase_share == pytest.approx(6 / chars) and ann.digit_share == pytest.approx(2 / chars)
    assert ann.punctuation_share == pytest.approx(2 / chars) and ann.type_token_ratio == pytest.approx(4 / 5)
    assert got["bob"].active_hours == 0 and got["bob"].type_token_ratio is None and got["bob"].sd_length is None


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_switches_do_not_depend_on_the_stretches(spark, width):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"c{i % 7}", i, rng.choice(["en", "ru", "unknown", None])) for i in range(300)]
    expected = {}
    for conversation in {r[0] for r in rows}:
        seen = [r[2] for r in rows if r[0] == conversation and r[2] not in (None, "unknown")]
        expected[conversation] = (len(seen), sum(a != b for a, b in zip(seen, seen[1:])))
    data = frame(spark, rows, "conv string, turn int, language string")
    got = actors.code_switches(data, "conv", ["turn"], F.floor(F.col("turn") / width))
    assert {r.conversation: (r.messages, r.switches) for r in got.collect()} == expected


def test_language_mix_entropy(spark):
    rows = [("a", "en")] * 3 + [("a", "ru")] + [("b", "en")]
    got = {(r.actor, r.language): (r.share, r.entropy) for r in actors.language_mix(frame(spark, rows, "actor string, language string")).collect()}
    entropy = -(0.75 * math.log2(0.75) + 0.25 * math.log2(0.25))
    assert got["a", "en"] == pytest.approx((0.75, entropy)) and got["a", "ru"] == pytest.approx((0.25, entropy))
    assert got["b", "en"] == pytest.approx((1.0, 0.0))


def test_quiet_hours_wrap_around_midnight(spark):
    rows = [("a", dt.datetime(2024, 1, 1, h)) for h in range(6, 22)] + [("a", dt.datetime(2024, 1, 1, 21))]
    row = actors.activity_hours(frame(spark, rows, "actor string, timestamp timestamp")).first()
    assert (row.quiet_start, row.quiet_messages, row.h21, row.h23) == (22, 0, 2, 0)


def test_graph(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", "b", at), ("a", "b", at.replace(day=3)), ("b", "a", at), ("a", "c", at), ("d", "d", at), ("a", None, at)]
    edge_list = actors.edges(frame(spark, rows, "actor string, recipient string, timestamp timestamp"))
    by_pair = {(r.sender, r.recipient): (r.messages, r.first_seen.day, r.last_seen.day) for r in edge_list.collect()}
    assert by_pair == {("a", "b"): (2, 1, 3), ("b", "a"): (1, 1, 1), ("a", "c"): (1, 1, 1), ("d", "d"): (1, 1, 1)}
    degrees = {r.node: (r.out_degree, r.in_degree, r.sent, r.received) for r in actors.node_degrees(edge_list).collect()}
    assert degrees == {"a": (2, 1, 3, 1), "b": (1, 1, 1, 2), "c": (0, 1, 0, 1), "d": (1, 1, 1, 1)}
    pairs = {(r.a, r.b): (r.a_to_b, r.b_to_a, r.reciprocal) for r in actors.reciprocity(edge_list).collect()}
    assert pairs == {("a", "b"): (2, 1, True), ("a", "c"): (1, 0, False)}


# --- storage -----------------------------------------------------------------------------------


def test_parquet_helpers(spark, tmp_path):
    path = str(tmp_path / "deep" / "t.parquet")
    data = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string").coalesce(1)
    parquet.write_parquet(data, path)
    assert parquet.read_parquet(spark, path, ["b"]).columns == ["b"]
    with pytest.raises(FileExistsError):
        parquet.write_parquet(data, path, overwrite=False)
    with pytest.raises(FileNotFoundError):
        parquet.read_parquet(spark, str(tmp_path / "none"))
    info = parquet.parquet_info(spark, path).collect()
    assert [(r.rows, r.columns) for r in info] == [(2, ["a", "b"])]
    listed = parquet.list_parquet_files(spark, str(tmp_path)).collect()
    assert len(listed) == 1 and listed[0].path.endswith(".snappy.parquet")
    with pytest.raises(NotADirectoryError):
        parquet.list_parquet_files(spark, str(tmp_path / "none"))


def test_metadata_decoding(spark):
    data = frame(spark, [(1, '{"a": [1, "x"]}'), (2, None), (3, "{broken")], "id int, metadata string")
    got = decode_metadata(data).select("id", F.to_json("metadata").alias("m")).collect()
    assert {r.id: json.loads(r.m) for r in got} == {1: {"a": [1, "x"]}, 2: {}, 3: {}}
    with pytest.raises(Exception, match="MALFORMED"):
        decode_metadata(data, strict=True).collect()


def test_flags(spark):
    rows = [(dt.datetime(2024, 1, 31, 23), "en"), (dt.datetime(2024, 2, 1), "ru"), (None, "de")]
    data = frame(spark, rows, "timestamp timestamp, language string")
    ranged = clean.flag_date_range(data, ("2024-01-01", "2024-01-31"))
    assert {r.language: r.in_range for r in ranged.collect()} == {"en": True, "ru": False, "de": None}
    assert clean.flag_date_range(data, ("2024-01-01", "2024-01-31"), only=True).count() == 1
    assert {r.in_range for r in clean.flag_date_range(data, None).collect()} == {None}
    expected = clean.flag_expected_language(data, ("en", "ru"))
    assert {r.language: r.expected_language for r in expected.collect()} == {"en": True, "ru": True, "de": False}


def test_a_failed_write_keeps_what_was_there(spark, tmp_path):
    path = str(tmp_path / "table")
    parquet.write_parquet(spark.range(3), path)
    with pytest.raises(Exception):
        parquet.write_parquet(spark.range(5).select(F.raise_error(F.lit("stop")).cast("bigint").alias("id")), path)
    assert spark.read.parquet(path).count() == 3
    # A table may be rewritten from itself.
    parquet.write_parquet(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2
    assert [entry.name for entry in tmp_path.iterdir()] == ["table"]


def test_term_counts_within_rows_and_over_rows_of_one_key(spark):
    rows = [("a", "red blue red"), ("a", "red"), ("b", ""), ("c", None), (None, "blue blue"), ("d", "x " * 2000 + "red")]
    counts = terms.term_counts(frame(spark, rows, "id string, raw_text string"), "id", bigrams=False)
    # Before a run the plan is there once; after it the initial and the final one are.
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    expected = {("a", "red"): 3, ("a", "blue"): 1, (None, "blue"): 2, ("d", "red"): 1}
    assert {(r.id, r.term): r.n for r in counts.collect() if r.term != "x"} == expected


def test_vocabulary_of_many_slices_and_shared_keys(spark, monkeypatch):
    """Batches are cut and joined by their size; rows of one key, or of none, count as one document."""
    monkeypatch.setattr(terms, "BYTES", 40)
    chance = random.Random(4)
    rows = [(f"k{i % 50}" if i % 9 else None, " ".join(chance.choices(["alpha", "beta", "the", "gamma", "delta"], k=i % 12)) or None) for i in range(70)]
    rows += [(f"s{i}", "alpha beta alpha beta") for i in range(5)]

    def plain(text):
        words = [w for w in (text or "").split() if w != "the"]
        return words + [f"{x} {y}" for x, y in zip(words, words[1:])]

    per_key, per_row = {}, Counter(t for _, text in rows for t in set(plain(text)))
    for key, text in rows:
        per_key.setdefault(key, Counter()).update(plain(text))
    df = Counter(t for found in per_key.values() for t in found)
    documents = frame(spark, rows, "id string, raw_text string").coalesce(2)
    found = [(r.id, r.term, r.n) for r in terms.vocabulary_counts(documents, "id", min_df=8, stop_words=["the"]).collect()]
    assert sorted(found, key=str) == sorted(((k, t, n) for k, some in per_key.items() for t, n in some.items() if df[t] >= 8), key=str)
    listed = {r.term: r.documents for r in terms.document_frequencies(documents, min_df=8, stop_words=["the"]).collect()}
    assert listed == {t: n for t, n in per_row.items() if n >= 8}


def test_a_batch_gives_each_term_once(spark):
    """Not one row for each document: that is what travels."""
    rows = [(i, "common words of all texts") for i in range(1000)]
    documents = spark.createDataFrame(rows, "id long, raw_text string").coalesce(1)
    assert terms.postings(documents, "id", "raw_text", (), True).count() == 9


def test_counts_of_documents_do_not_travel(spark):
    """Texts are shuffled once, and terms without their documents: no row of a term and a document meets others by term."""
    rows = [(i, f"common words of all texts own{i} pair{i // 2}") for i in range(400)]
    rows += [(None, None), (None, "common words"), (7, "common common"), (1000, ""), (1001, "x the")]
    documents = spark.createDataFrame(rows, "id long, raw_text string").repartition(4)
    kept = terms.vocabulary_counts(documents, "id", min_df=2, stop_words=["the"], bigrams=False)
    found = {(r.id, r.term): r.n for r in kept.collect()}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan and "ReusedExchange" in plan
    want = {(i, t): 1 for i in range(400) for t in ("common", "words", "of", "all", "texts", f"pair{i // 2}")}
    assert found == want | {(7, "common"): 3, (None, "common"): 1, (None, "words"): 1}
    assert terms.vocabulary_counts(documents.where("false"), "id").count() == 0
