"""JSON documents read in byte ranges give what reading them whole gives."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from chatseam.sources import ranges, raw

TRICKY = {
    "array": json.dumps([{"a": 1, "t": 'x } ] { [ " \\ \\" y'}, 5, {"b": {"c": [{"d": 1}, {"e": [2]}]}}, "s }", [{"z": 1}], {}, {"k": "}"}, None]),
    "envelope": json.dumps({"meta": {"x": {"y": [1]}, "messages": [{"no": 1}]}, "messages": [3, {"a": 1}, {"b": [1, {"c": 2}]}, 7], "n": 3, "data": [{"no": 1}]}, indent=1),
    "later_key": '{"items":[{"no":1}],"messages":{"m":[{"no":2}]},"data" : [ {"q":2} , {"r":"é}"} ] } \n',
    "empty_list": '{"records":[],"items":[{"q":1}]}',
    "bare": json.dumps({"only": {"x": 1}, "l": [1, {"y": 2}], "s": "}"}) + "\n",
    "empty_object": "{}", "nothing": "[]", "blank_list": "﻿ [ ]\n", "plain_items": '[1, "x}", [2]]',
    "cut": '[{"a":1},{"b":2', "cut_envelope": '{"messages":[{"a":1},{"b":2}', "text": ' "str} " ', "empty": "", "two": "[1] {",
}


def big(rng: random.Random) -> list:
    text = lambda: "".join(rng.choice('ab}{][",:\\é \n') for _ in range(rng.randrange(12)))
    value = lambda d: text() if d == 0 or rng.random() < 0.4 else {text(): value(d - 1) for _ in range(rng.randrange(3))} if rng.random() < 0.5 else [value(d - 1) for _ in range(rng.randrange(3))]
    return [{f"k{j}": value(3) for j in range(rng.randrange(4))} if rng.random() < 0.9 else value(2) for _ in range(120)]


@pytest.fixture
def small_splits(spark):
    old = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for key, value in zip(old, ("300", "1")):
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


def rows(frame):
    return sorted((r[0], r[1], r[2]) for r in frame.select("record_file", "ordinal", F.to_json(F.col("rec")).alias("rec")).collect())


def test_same_as_whole_documents(spark, tmp_path, small_splits):
    rng = random.Random(4)
    for name, text in TRICKY.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    for k in range(3):
        (tmp_path / f"big{k}.json").write_text(json.dumps(big(rng), ensure_ascii=k == 0, indent=k or None), encoding="utf-8")
        (tmp_path / f"wrapped{k}.json").write_text(json.dumps({"a": {"b": big(rng)[:5]}, "records": big(rng), "z": 1}), encoding="utf-8")
    directory = str(tmp_path)
    want = rows(raw.read_json(spark, directory))
    assert len(want) > 500
    assert rows(raw.read_json(spark, directory, large=-1)) == want
    whole, ranged = (sorted(map(tuple, raw.json_rejects(spark, directory, large=large).collect())) for large in (1 << 30, -1))
    assert ranged == whole
    assert rows(raw.read_json(spark, directory, large=1000)) == want


def test_only_messages_and_no_bare_objects(spark, tmp_path):
    for name in ("bare", "envelope", "later_key", "array"):
        (tmp_path / f"{name}.json").write_text(TRICKY[name], encoding="utf-8")
    whole, ranged = (rows(raw.read_json(spark, str(tmp_path), ("messages",), bare_object=False, large=large)) for large in (1 << 30, -1))
    assert ranged == whole and {r[0] for r in whole} == {"envelope.json", "array.json"}


def test_an_invalid_item_is_left_out_alone(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a":1},{bad},{"c":3}]')
    assert [r[1] for r in rows(raw.read_json(spark, str(tmp_path), large=-1))] == [0, 2]
    assert [r["reason"] for r in raw.json_rejects(spark, str(tmp_path), large=-1).collect()] == ["item 1 is not valid JSON"]


def test_parts_of_a_piece():
    found = ranges.list_parts('b"],"n":3,"data":[{"x":[1]', True, 2, 2)
    assert [(p["key"], p["text"], p["closed"]) for p in found["parts"]] == [(None, 'b"', True), ("=data", '{"x":[1]', False)]
    assert (found["after"], found["opened"]) == ("=data", ["=data"])
