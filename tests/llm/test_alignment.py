"""Alignment against a brute-force version with the tokenizers' own files."""

from __future__ import annotations

import os
from collections import Counter
from functools import lru_cache
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatseam.llm import alignment

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@lru_cache
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    assert decoders
    # Byte-level letters: printable bytes stand for themselves, the others for code points from 256 on.
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in own)}
    return a, b, letters


def tokens(text):
    a, b, letters = encoders()
    if not text:
        return [], []
    left = [(k, bytes(letters[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(k, bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()) for k in b.encode(text) for p in [b.id_to_piece(k)]]
    if any(b"".join(d for _, d in side) != b" " + text.encode() for side in (left, right)):
        return [], []
    return left, right


def spans(side):
    at, out = 0, []
    for k, data in side:
        out.append((k, at, at + len(data)))
        at += len(data)
    return out


def brute(rows) -> Counter:
    parts, counts = [], Counter()
    for doc_id, text in rows:
        left, right = (spans(x) for x in tokens(text))
        links, j = [], 0
        for a, start, end in left:
            while j and right[j][1] > start:
                j -= 1
            while j < len(right) and right[j][1] < end:
                if right[j][2] > start:
                    links.append((a, right[j][0]))
                j += 1
            j = min(j, len(right) - 1)
        cuts = sorted({e for *_, e in left} & {e for *_, e in right})
        groups = []
        for low, high in zip([0, *cuts], cuts):
            groups.append(",".join(str(k) for k, s, _ in left if low <= s < high) + "|" + ",".join(str(k) for k, s, _ in right if low <= s < high)) if len(left) < 3000 else groups.append("")
        counts.update(links)
        parts.append((doc_id, len(left), len(right), len(cuts), links, ";".join(groups)))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return Counter(
        (d, a, b, g, len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), (sha256(t.encode()).hexdigest() if a else "") if a < 3000 else None)
        for d, a, b, g, x, t in parts
    )


def result(frame) -> Counter:
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = [list(r) for r in frame.select(*columns).collect()]
    return Counter((*r[:7], r[7] if r[1] < 3000 else None) for r in found)


def test_documents(documents, clashing, no_documents):
    texts = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    want = brute(texts)
    assert result(alignment.alignment(documents)[0]) == want
    assert result(alignment.alignment(clashing)[0]) == want
    assert alignment.alignment(no_documents)[0].count() == 0


def test_many_chunks(documents, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 2000)
    want = brute([tuple(r) for r in documents.select("doc_id", "text").collect()])
    docs, pairs = alignment.alignment(documents)
    assert result(docs) == want
    links = docs.agg(F.sum("n_links")).first()[0]
    assert pairs.agg(F.sum("n")).first()[0] == links and pairs.groupBy("a", "b").count().where("count > 1").isEmpty()


def test_special_strings(spark):
    rows = [(1, "<|endoftext|> <s> </s> <unk> <0x41> a<|endoftext|>"), (2, "▁a ▁"), (3, "  two  spaces \n\n\t x"), (4, "\x00nul\x01"), (5, "aaaa" * 40), (6, "日本語 текст 🙂🙂 é"), (7, " "), (8, "\r\n")]
    assert result(alignment.alignment(spark.createDataFrame(rows, "doc_id long, text string"))[0]) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(codec="utf-8"), min_size=1, max_size=60))
def test_ids_are_those_of_the_json_file(text):
    a, *_ = encoders()
    assert ENCODER.encode_ordinary(" " + text) == a.encode(" " + text, add_special_tokens=False).ids


ENCODER = alignment.Tokenizers().a()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert result(alignment.op11_alignment(spark, SF_DIR)) == brute(rows)
