"""The work of cutting documents into records grows with the pieces, however they share out among documents."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from chatseam.plans.ingest_queries import _pieces, json_array_ranges
from chatseam.sources.ranges import cut_records

TEXTS = {
    1: json.dumps([{"a": k, "s": f'}}]{{ " \\ {k}'} for k in range(40)]),
    2: '{"n":{"x":[{}]},"messages":[{"a":1},7,{"b":{"c":2}}]}',
    3: '{"only":{"x":1}}',
    4: '[{"a":1},{bad},{"c":3}]',
    5: '[{"a":1},{"b"',
    6: "",
}


@pytest.fixture
def documents(spark):
    return spark.createDataFrame(list(TEXTS.items()), "path long, text string")


def optimized(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def executed(frame) -> str:
    """The plan as it ran."""
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_document_is_split_once_not_for_each_piece(documents):
    pieces = _pieces(documents)
    assert optimized(pieces).count("split(") == 1
    found = {}
    for row in pieces.orderBy("path", "seen").collect():
        assert row["size"] == len(TEXTS[row["path"]]) and row["range"] == row["seen"] // 7
        found.setdefault(row["path"], []).append(row["value"])
    parts = {path: text.split("}") for path, text in TEXTS.items()}
    assert found == {path: part if part[-1] else part[:-1] for path, part in parts.items() if part != [""]}


def test_ranges_of_a_document_gather_no_lists_of_all_its_ranges(documents):
    windows = [line for line in optimized(cut_records(_pieces(documents), ("messages",))).splitlines() if "Window [" in line]
    assert windows and not any("collect_list" in line for line in windows)


def test_texts_of_items_are_gathered_and_parsed_in_one_place(documents):
    plan = executed(cut_records(_pieces(documents), ("messages",)))
    assert plan.count(" collect_list(struct(range, ") == 1


def test_records_and_refusals_of_all_kinds(documents):
    def rows(**options):
        cut = cut_records(_pieces(documents), ("messages",), **options)
        return sorted((r[0], -1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in cut.select("path", "ordinal", F.to_json("rec"), "reason").collect())

    want = [
        *[(1, k, json.dumps(item, separators=(",", ":")), "") for k, item in enumerate(json.loads(TEXTS[1]))],
        (2, 0, '{"a":1}', ""), (2, 1, "", "item 1 is not an object"), (2, 2, '{"b":{"c":2}}', ""),
        (3, 0, '{"only":{"x":1}}', ""),
        (4, 0, '{"a":1}', ""), (4, 1, "", "item 1 is not valid JSON"), (4, 2, '{"c":3}', ""),
        (5, -1, "", "not a JSON list or object"),
    ]
    assert rows() == want
    assert rows(bare_object=False) == [row for row in want if row[0] != 3]


def test_one_user_has_all_events(spark, tmp_path):
    events = [(k, 1, ("view", "click", None)[k % 3], json.dumps({"k": k, "s": "}]"}) if k % 5 else None) for k in range(6000)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    found = sorted(json_array_ranges(spark, str(tmp_path)).collect())
    assert [tuple(row) for row in found] == [(1, k, k, kind, props) for k, (_, _, kind, props) in enumerate(events)]
