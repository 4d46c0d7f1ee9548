"""Packing against the tokenizer itself, the plan against its bounds."""

from __future__ import annotations

import os
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatseam.llm import packing

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

ENCODER = packing.WordTokenizer(packing.TOKENIZER)


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.TOKENIZER)


def ids_of(text: str | None) -> list[int]:
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, packing.END]


def brute_pieces(rows) -> Counter:
    out = Counter()
    for doc_id, text in rows:
        ids = ids_of(text)
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            out[(doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    return out


def check_packed(rows, capacity: int) -> int:
    """Sequences are gapless and no longer than the capacity; returns their number."""
    placed = defaultdict(list)
    for r in rows:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(placed)


def test_units_have_the_tokenizers_ids():
    texts = [
        None, "", " \n\t", "It's WE'LL they've I'd'm ''s '' 's", "a_b __ _1 12 x²¼ 3rd", "\x1c\x1d a\x1fb\x85c\xa0d", "<|endoftext|> a<|startoftext|>b <| |>",
        "Çeux ŒUVRE ǅ İstanbul ẞ straße ΣΑΣ ς", "é café ﬁ", "при вет 你好 \U0001f600  x", "x" * 9000, "!?" * 500, "'" * 7 + "re're", "ªº µ ƻ ǀ ʰ", "Z̀" * 9,
    ]
    for _ in range(2):
        for text, data in zip(texts, ENCODER.encode(texts), strict=True):
            assert np.frombuffer(data, "<u4").tolist() == ids_of(text)[:-1], text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=30), max_size=5), st.text("s'tremld _1²\x1c\x85aÉ!<|", max_size=20))
def test_any_text_has_the_tokenizers_ids(texts, dense):
    texts = [*texts, dense]
    assert [np.frombuffer(x, "<u4").tolist() for x in ENCODER.encode(texts)] == [ids_of(t)[:-1] for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 60), max_size=12))
def test_plan_uses_every_length_and_is_short(counts):
    steps = packing.plan(counts, 24)
    used = Counter()
    for often, parts in steps:
        assert often > 0 and sum(parts) <= 24
        for length in parts:
            used[length] += often
    assert used == Counter(counts)
    total = sum(k * n for k, n in counts.items())
    # The bound of best fit decreasing: 11/9 of the optimum and 1.
    lower = max(-(-total // 24), sum(n for k, n in counts.items() if k > 12))
    assert sum(often for often, _ in steps) <= lower * 11 / 9 + 1 or sum(often for often, _ in steps) <= best_fit(counts, 24)


def best_fit(counts, capacity):
    gaps = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fitting = [g for g in gaps if g >= length]
        gap = min(fitting, default=capacity)
        if fitting:
            gaps.remove(gap)
        gaps.append(gap - length)
    return len(gaps)


def test_exact_combinations_fill_gaps():
    for counts in ({30: 5, 10: 5}, {30: 5, 6: 5, 4: 5}, {30: 4, 5: 4, 3: 4, 2: 4}, {20: 8}, {13: 3, 14: 6}, {8: 5}, {1: 80}):
        total = sum(k * n for k, n in counts.items())
        assert sum(n for n, _ in packing.plan(counts, 40)) == -(-total // 40) or 13 in counts


def test_pack_keeps_rows(spark):
    rows = [(k, 1 + k * 7 % 50, "x") for k in range(500)] + [(900, None, "n"), (901, 0, "z"), (902, 65, "long"), (903, 64, None)] + [(7, 64, "same")] * 40 + [(None, 3, None)] * 5
    frame = spark.createDataFrame(rows, "id long, length int, _rest string").withColumns({"sequence_id": F.lit("old"), "_key": F.lit(1), "_rank": F.lit(2), "at": F.lit(3)})
    found = packing.pack(frame.repartition(3), 64).collect()
    assert Counter((r["id"], r["length"], r["_rest"], r["_key"], r["_rank"], r["at"]) for r in found) == Counter((*r, 1, 2, 3) for r in rows)
    outside = [r for r in found if r["length"] is None or not 1 <= r["length"] <= 64]
    assert {(r["sequence_id"], r["offset"]) for r in outside} == {(None, None)} and len(outside) == 3
    inside = [r for r in found if r not in outside]
    assert check_packed(inside, 64) <= -(-sum(r["length"] for r in inside) // 64) + 1
    assert packing.pack(frame.where("false"), 64).count() == 0


def test_documents(documents, clashing, no_documents):
    for frame in (documents, clashing):
        pieces = packing.token_pieces(frame)
        found = packing.pack(pieces.withColumn("crc", F.crc32("ids"))).collect()
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["crc"]) for r in found) == brute_pieces([tuple(r) for r in frame.select("doc_id", "text").collect()])
        check_packed(found, 4096)
    whole = packing.sequences(packing.pack(packing.token_pieces(documents))).collect()
    ids = {(r["doc_id"], r["piece"]): bytes(r["ids"]) for r in packing.token_pieces(documents.where("doc_id < 28")).collect()}
    for r in whole:
        assert len(r["ids"]) == 4 * r["length"] <= 4 * 4096
        for doc_id, start in zip(r["doc_ids"], r["starts"]):
            if (own := ids.get((doc_id, 0))) and doc_id != 26:
                assert bytes(r["ids"])[4 * start : 4 * start + len(own)] == own
    assert packing.token_pieces(no_documents).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_query(spark):
    found = packing.op13_packing(spark, SF_DIR).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == brute_pieces(rows)
    used = check_packed(found, 4096)
    assert used == max(-(-sum(r["length"] for r in found) // 4096), sum(r["length"] > 2048 for r in found))
