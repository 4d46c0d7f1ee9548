"""The trie against a brute-force version and SQL; the rollup with components split in joins."""

from __future__ import annotations

import os
import random
import zlib
from collections import Counter, defaultdict
from hashlib import md5, sha256

import numpy as np
import pytest
from check import connect, difference
from pyspark.sql import functions as F

from chatseam.llm import tries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows) -> Counter:
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = md5(f"{len(role)}:{role}{text}".encode()).digest()
            turns[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {conv: [t[3:] for t in sorted(found)] for conv, found in turns.items()}
    paths = {}
    for conv, found in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        paths[conv] = tuple(own.get(conv - int(np.fmod(conv, 100)), [])[:h] + found[h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
            if d:
                children[path[: d - 1]].add(path[:d])
        ends[path].append(conv)
    leaves, saved = Counter(), Counter()
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(members[node]) - 1) * len(node[-1][1]) if node else 0
    return Counter(
        (
            min(found), len(node), min(members[node[:-1]]) if node else None, len(found), len(children.get(node, ())), leaves[node], saved[node],
            sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
        )
        for node, found in members.items()
    )


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    found = []
    for conv in [*range(0, 60), *range(100, 130), 250, 251, 399, -5, -105, -100]:
        same = rng.random() < 0.5
        for turn in range(rng.choice([1, 2, 3, 7, 12])):
            found.append((conv, turn * 10, "user" if turn % 2 == 0 else "assistant", f"t{turn}" if same else f"é{turn} {rng.randrange(3)}"))
    found += [(300, None, None, None), (300, 5, "user", None), (300, 5, None, "x"), (300, 5, "user", "y"), (300, 5, "user", "y"), (None, 1, "user", "lost"), (301, 1, None, "")]
    found += [(conv, turn, "user", f"deep {turn}") for conv in (500, 502, 577) for turn in range(300)]
    found += [(conv, 0, "user", "one very common turn") for conv in range(10_000, 10_400)]
    return found


@pytest.fixture(scope="module")
def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).cache()


def result(frame) -> Counter:
    return Counter(tuple(r) for r in frame.select(*COLUMNS).collect())


def test_trie(turns, rows):
    clash = turns.withColumns({name: F.lit(name) for name in ("position", "node", "depth", "part", "seen", "base", "n", "top")})
    assert result(tries.conversation_trie(clash)) == brute(rows)


def test_components_split_in_joins(turns, rows):
    assert result(tries.conversation_trie(turns, most=150)) == brute(rows)


def test_no_conversations(turns):
    assert tries.conversation_trie(turns.where("false")).count() == 0
    assert tries.conversation_trie(turns.where("conv_id is null")).count() == 0


def test_stretches(spark, monkeypatch):
    monkeypatch.setattr(tries, "STRETCH", 2)
    rows = [(conv, turn, "user", f"{turn // 9}") for conv in (0, 1, 2, 105) for turn in range(70)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)
    assert result(tries.conversation_trie(frame, most=40)) == brute(rows)


def test_small_components():
    rng = np.random.default_rng(1)
    for shape in ("random", "path", "star"):
        n = 400
        parent = {"random": [-1, *[int(rng.integers(max(0, k - 30), k)) for k in range(1, n)]], "path": list(range(-1, n - 1)), "star": [-1, *[0] * (n - 1)]}[shape]
        value, depth = rng.integers(0, 9, n), np.zeros(n, np.int64)
        want, below = value.copy(), np.ones(n, np.int64)
        for k in range(1, n):
            depth[k] = depth[parent[k]] + 1
        for k in range(n - 1, 0, -1):
            want[parent[k]] += want[k]
            below[parent[k]] += below[k]
        got = np.zeros(n, np.int64)
        tries.small_components(np.zeros(n, np.int64), np.array(parent), depth, below, [value], [got])
        assert got.tolist() == want.tolist()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_query(spark):
    assert difference(tries.op12_trie(spark, SF_DIR), connect(SF_DIR), tries._TRIE_SQL) is None
