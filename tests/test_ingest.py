"""Ingestion over small files in the shapes real dumps have. All rows are invented."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from chatseam.operators.normalize import normalize
from chatseam.plans.ingest import canonical_messages, run_corpus, run_enabled
from chatseam.schema import CANONICAL_COLUMNS
from chatseam.sources import raw
from chatseam.sources.parquet import corpus_path, read_corpora, read_rejected
from chatseam.specs import CorpusSpec, IngestSettings, get_spec, load_specs

CHAT = [
    {"id": "m-77", "date": "2019-11-12 21:47:10", "from": "tove", "to": "ruth", "text": "the shipment leaves with the evening train"},
    {"id": "m-30", "date": "2019-11-13 13:02:05", "from": "olaf", "to": "tove", "text": "hm"},
    {"id": "m-12", "date": "2019-11-12 06:15:42", "from": "ruth", "to": "olaf", "text": "мы не знаем когда он вернется из города"},
    {"id": "m-77", "date": "2019-11-16 19:00:09", "from": "pia", "to": "pia", "text": "the later text under an id that was seen"},
    {"id": "m-41", "date": "2019-11-14 17:33:59", "from": "pia", "to": "ruth", "text": "that is what the others said about it"},
    {"id": "m-12", "date": "2019-11-17 03:30:00", "from": "ruth", "to": "olaf", "text": "это снова тот же номер"},
    {"id": "m-43", "date": "2019-11-15 00:00:30", "from": "pia", "to": "olaf", "text": "and the keys are in the drawer"},
    {"id": "m-42", "date": "2019-11-14 17:35:01", "from": "ruth", "to": "pia", "text": "это было не то что мы хотели"},
]
CSV_LINES = [
    "id,date,from,to,text",
    "9001,2020-07-19 23:58:01,NA,uwe,opening row without quotes",
    '9002,2020-07-20 00:00:00,uwe,,"cells; with, separators"',
    '9003,2020-07-20 04:44:44,vera,uwe,"""quoted"" from the start"',
    '9004,2020-07-22 11:11:11,vera,wim,"one line\n\nand a third"',
    "9005,2020-07-22 12:12:12,wim,vera,closing row of the file",
]
TEXT_LINES = [
    "nothing but words on this line",
    '{"msg_id": "j/5", "timestamp": "2020-08-30 16:20:00", "sender": "wim", "recipient": "yara", "body": "object on a line"}',
    "another line of words",
]
EVENTS = [
    {"event_id": "$k7", "type": "m.room.member", "origin_server_ts": 1583020799000, "sender": "@quin:home",
     "room_id": "!den:home", "content": {"membership": "invite"}},
    {"event_id": "$b3", "type": "m.room.message", "origin_server_ts": 1583020800000, "sender": "@rolf:home",
     "room_id": "!den:home", "content": {"msgtype": "m.text", "body": "who took the ladder"}},
    {"event_id": "$x1", "type": "m.reaction", "origin_server_ts": 1583107205000, "sender": "@quin:home",
     "room_id": "!den:home", "content": {"key": "+1"}},
    {"event_id": "$e9", "type": "m.room.message", "origin_server_ts": 1583193600000, "sender": "@sven:away",
     "room_id": "!loft:home", "content": {"msgtype": "m.text", "body": "it stands behind the shed"}},
    {"event_id": "$a2", "type": "m.room.message", "origin_server_ts": 1583280000000, "sender": "@bot:home",
     "room_id": "!loft:home", "content": {"msgtype": "m.notice", "body": "three new photos today"}},
]
TICKETS = [
    {"id": "q-8", "created_at": "2018-05-06 07:08:09", "sender": "mona", "to": "nils", "description": "only described"},
    {"id": "q-2", "created_at": "2018-05-09 22:10:00", "sender": "nils", "to": "mona", "message": "the printer is out",
     "status": "closed", "priority": 5},
    {"id": "q-5", "created_at": "2018-05-07 15:45:30", "sender": "otto", "to": "nils", "body": "body of its own",
     "message": "message beside it"},
    {"id": "q-4", "created_at": "2018-06-01 12:00:00", "sender": "nils", "to": "otto", "message": "paper is back again"},
    {"id": "q-9", "created_at": "2018-06-02 12:00:00", "sender": "otto", "to": "mona", "message": "thanks to everybody"},
]


def write(directory, name, content):
    directory.mkdir(parents=True, exist_ok=True)
    if not isinstance(content, (str, bytes)):
        content = json.dumps(content, ensure_ascii=False)
    path = directory / name
    if isinstance(content, bytes):
        path.write_bytes(content)
    else:
        path.write_text(content, encoding="utf-8")
    return path


def spec_at(name, directory, **changes):
    return replace(get_spec(name), raw_dir=str(directory), **changes)


def canonical(spark, spec, settings=IngestSettings()):
    rows = canonical_messages(raw.read_corpus_raw(spark, spec), spec, settings).orderBy("message_id").collect()
    return [row.asDict() for row in rows]


def records(spark, rows):
    """In-memory raw records: (file, ordinal, fields)."""
    frame = spark.createDataFrame(
        [(file, file, 0, i, json.dumps(fields)) for file, i, fields in rows],
        "source_file string, record_file string, format_rank int, ordinal bigint, j string",
    )
    return frame.select(*frame.columns[:-1], F.parse_json("j").cast("map<string,variant>").alias("rec"))


# --- whole runs ----------------------------------------------------------------


def test_chat_run(spark, tmp_path):
    write(tmp_path / "in", "a.json", CHAT)
    result = run_corpus(spark, spec_at("conti", tmp_path / "in"), str(tmp_path / "out"))
    assert (result.records_raw, result.records_after_normalize) == (8, 8)
    assert (result.records_after_clean, result.records_written) == (5, 5)
    assert result.drop_rate == 0.375
    assert result.language_distribution == {"en": 3, "ru": 2}
    back = read_corpora(spark, str(tmp_path / "out"))
    assert back.columns == CANONICAL_COLUMNS
    assert back.schema["timestamp"].dataType.simpleString() == "timestamp"
    rows = {row.message_id: row for row in back.collect()}
    assert set(rows) == {"m-12", "m-41", "m-42", "m-43", "m-77"}
    assert rows["m-77"].raw_text == "the shipment leaves with the evening train"
    assert json.loads(rows["m-77"].metadata) == {"recipient": "ruth"}
    assert rows["m-12"].source_file == "a.json"
    assert rows["m-12"].timestamp == dt.datetime(2019, 11, 12, 6, 15, 42)


def test_dry_run_writes_nothing_and_counts_valid_rows_q13(spark, tmp_path):
    write(tmp_path / "in", "a.json", CHAT)
    result = run_corpus(spark, spec_at("conti", tmp_path / "in"), str(tmp_path / "out"), dry_run=True)
    assert (result.records_written, result.output_path) == (5, "")
    assert not (tmp_path / "out").exists()


def test_missing_directory_and_empty_directory(spark, tmp_path):
    assert run_corpus(spark, spec_at("conti", tmp_path / "none"), str(tmp_path / "o")).records_raw == 0
    (tmp_path / "empty").mkdir()
    result = run_corpus(spark, spec_at("babuk", tmp_path / "empty"), str(tmp_path / "o"))
    assert (result.records_raw, result.drop_rate) == (0, 0.0)


def test_csv_and_text_keep_all_rows_q1(spark, tmp_path):
    write(tmp_path, "log.csv", "\n".join(CSV_LINES) + "\n")
    write(tmp_path, "chat.txt", "\n".join(TEXT_LINES) + "\n")
    rows = canonical(spark, spec_at("babuk", tmp_path))
    assert [row["message_id"] for row in rows] == ["9001", "9002", "9003", "9004", "9005", "chat_1", "chat_3", "j/5"]
    by_id = {row["message_id"]: row for row in rows}
    assert by_id["9004"]["raw_text"] == "one line\n\nand a third"
    assert by_id["9003"]["raw_text"] == '"quoted" from the start'
    assert by_id["9001"]["actor"] is None and by_id["9002"]["metadata"] == "{}"
    assert by_id["chat_3"]["raw_text"] == TEXT_LINES[2]
    assert by_id["chat_1"]["timestamp"] is None and by_id["chat_1"]["actor"] is None


def test_event_export(spark, tmp_path):
    write(tmp_path / "in", "export.json", {"chunk": EVENTS})
    spec = spec_at("black_basta", tmp_path / "in")
    result = run_corpus(spark, spec, str(tmp_path / "out"))
    assert (result.records_raw, result.records_after_normalize, result.records_written) == (5, 3, 3)
    rows = {row["message_id"]: row for row in canonical(spark, spec)}
    assert rows["$b3"]["timestamp"] == dt.datetime(2020, 3, 1)
    assert rows["$b3"]["raw_text"] == "who took the ladder"
    meta = json.loads(rows["$b3"]["metadata"])
    assert meta["recipient"] == "!den:home" and meta["type"] == "m.room.message"
    assert meta["content"] == {"body": "who took the ladder", "msgtype": "m.text"}


def test_msgtype_filter_is_optional_q7(spark, tmp_path):
    write(tmp_path, "export.json", EVENTS)
    rows = canonical(spark, spec_at("black_basta", tmp_path, msgtypes=("m.text",)))
    assert [row["message_id"] for row in rows] == ["$b3", "$e9"]


def test_tickets_promotion_and_passthrough(spark, tmp_path):
    write(tmp_path, "t.json", {"records": TICKETS})
    rows = {row["message_id"]: row for row in canonical(spark, spec_at("lockbit", tmp_path))}
    assert {k: v["raw_text"] for k, v in rows.items()} == {
        "q-2": "the printer is out", "q-4": "paper is back again", "q-5": "body of its own", "q-8": "only described",
        "q-9": "thanks to everybody",
    }
    assert json.loads(rows["q-2"]["metadata"]) == {
        "recipient": "mona", "lk_status": "closed", "lk_priority": 5, "message": "the printer is out",
        "status": "closed", "priority": 5,
    }
    assert json.loads(rows["q-5"]["metadata"]) == {"recipient": "nils", "message": "message beside it"}


def test_rerun_replaces_only_its_corpus(spark, tmp_path):
    write(tmp_path / "a", "a.json", CHAT)
    write(tmp_path / "b", "t.json", TICKETS)
    out = str(tmp_path / "out")
    first = {"conti": {"raw_dir": str(tmp_path / "a"), "enabled": True},
             "lockbit": {"raw_dir": str(tmp_path / "b"), "enabled": True},
             "babuk": {"raw_dir": str(tmp_path / "b")}}
    results = run_enabled(spark, load_specs(first), out)
    assert {name: r.records_written for name, r in results.items()} == {"conti": 5, "lockbit": 5}
    write(tmp_path / "a", "a.json", CHAT[:1])
    run_corpus(spark, load_specs(first)["conti"], out)
    counts = {r["dataset"]: r["count"] for r in read_corpora(spark, out).groupBy("dataset").count().collect()}
    assert counts == {"conti": 1, "lockbit": 5}


def test_failing_corpus_does_not_stop_the_others(spark, tmp_path):
    write(tmp_path / "a", "a.json", CHAT)

    def broken(spark, spec):
        raise RuntimeError("broken loader")

    specs = {
        "bad": CorpusSpec("bad", {}, enabled=True, load=broken),
        "conti": spec_at("conti", tmp_path / "a", enabled=True),
    }
    results = run_enabled(spark, specs, str(tmp_path / "out"))
    assert list(results) == ["bad", "conti"]
    assert results["bad"].error == "RuntimeError: broken loader" and results["bad"].records_raw == 0
    assert results["conti"].error == "" and results["conti"].records_written > 0
    assert run_enabled(spark, {}, str(tmp_path / "out")) == {}


def test_rejected_rows_are_kept_apart(spark, tmp_path):
    write(tmp_path / "in", "a.json", CHAT)
    spec = spec_at("conti", tmp_path / "in")
    checked = canonical_messages(raw.read_corpus_raw(spark, spec), spec)
    spoiled = checked.withColumn("errors", F.when(F.col("message_id") == "m-41", F.array(F.lit("bad"))).otherwise(F.col("errors")))
    from chatseam.sources.parquet import write_corpus

    write_corpus(spoiled, str(tmp_path / "out"), "conti")
    assert read_corpora(spark, str(tmp_path / "out")).count() == 4
    rejected = read_rejected(spark, str(tmp_path / "out")).collect()
    assert [(r.message_id, r.errors) for r in rejected] == [("m-41", ["bad"])]
    assert corpus_path("x/", "conti") == "x/dataset=conti"


# --- readers -----------------------------------------------------------------


def loaded(frame):
    rows = frame.select(
        "record_file", "ordinal", F.to_json("rec").alias("rec")
    ).orderBy("format_rank", "record_file", "ordinal").collect()
    return [(r.record_file, r.ordinal, json.loads(r.rec)) for r in rows]


def test_json_envelopes(spark, tmp_path):
    write(tmp_path, "a.json", [{"n": 1}, {"n": 2}])
    write(tmp_path, "b.json", {"messages": "no list", "data": [{"n": 3}], "items": [{"n": 9}]})
    write(tmp_path, "c.json", {"n": 4})
    write(tmp_path, "d.json", {"items": []})
    assert loaded(raw.read_json(spark, str(tmp_path))) == [
        ("a.json", 0, {"n": 1}), ("a.json", 1, {"n": 2}), ("b.json", 0, {"n": 3}), ("c.json", 0, {"n": 4}),
    ]


def test_event_envelope_order(spark, tmp_path):
    write(tmp_path, "a.json", {"data": [{"n": 1}], "events": [{"n": 2}], "chunk": {"n": 3}})
    frame = raw.read_json(spark, str(tmp_path), ("chunk", "events", "messages", "data"))
    assert loaded(frame) == [("a.json", 0, {"n": 2})]


def test_bad_documents_are_listed_not_fatal(spark, tmp_path):
    write(tmp_path, "good.json", [{"n": 1}, 7, {"n": 2}])
    write(tmp_path, "broken.json", '[{"n": 1}, {"n"')
    write(tmp_path, "scalar.json", "42")
    write(tmp_path, "trailing.json", '[{"n": 1}] and more')
    write(tmp_path, "trailing_object.json", '{"n": 1} {"n": 2}')
    assert loaded(raw.read_json(spark, str(tmp_path))) == [("good.json", 0, {"n": 1}), ("good.json", 2, {"n": 2})]
    rejects = {(r.source_file, r.reason) for r in raw.json_rejects(spark, str(tmp_path)).collect()}
    assert rejects == {
        ("broken.json", "not a JSON list or object"),
        ("scalar.json", "not a JSON list or object"),
        ("trailing.json", "not a JSON list or object"),
        ("trailing_object.json", "not a JSON list or object"),
        ("good.json", "item 1 is not an object"),
    }


def test_repeated_key_and_invalid_utf8(spark, tmp_path):
    write(tmp_path, "a.json", b'[{"n": 1, "n": 2, "t": "bad \xff byte"}]')
    assert loaded(raw.read_json(spark, str(tmp_path))) == [("a.json", 0, {"n": 2, "t": "bad � byte"})]


def test_text_lines(spark, tmp_path):
    lines = ["", "  12 hello  ", '{"a": 1} trailing', "5] tricky", "5} tricky", "42", '"quoted"', "null", "true",
             "NaN", '{"a": [1, 2]}', '{"a": 1}', "true story", "[1, 2]", '{"a": 1} {"b": 2}', "x"]
    write(tmp_path, "log.v1.txt", "\r\n".join(lines))
    got = [rec for _, _, rec in loaded(raw.read_text(spark, str(tmp_path)))]
    assert got == [
        {"body": "12 hello", "msg_id": "log.v1_2"},
        {"body": '{"a": 1} trailing', "msg_id": "log.v1_3"},
        {"body": "5] tricky", "msg_id": "log.v1_4"},
        {"body": "5} tricky", "msg_id": "log.v1_5"},
        {"a": [1, 2]},
        {"a": 1},
        {"body": "true story", "msg_id": "log.v1_13"},
        {"body": '{"a": 1} {"b": 2}', "msg_id": "log.v1_15"},
        {"body": "x", "msg_id": "log.v1_16"},
    ]


def test_line_numbers_across_splits(spark, tmp_path):
    for name in ("one.txt", "two.txt"):
        write(tmp_path, name, "".join(f"line {i} of {name} {'x' * (i % 50)}\n" for i in range(3000)))
    settings = {"spark.sql.files.maxPartitionBytes": "7000b", "spark.sql.files.openCostInBytes": "10"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        frame = raw.read_text(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = loaded(frame)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len(got) == 6000
    for file, ordinal, rec in got:
        assert rec["body"].startswith(f"line {ordinal} of {file}")
        assert rec["msg_id"] == f"{file[:-4]}_{ordinal + 1}"


def test_csv_headers_differ(spark, tmp_path):
    write(tmp_path, "a.csv", "id,text\n1,one\n2,\n")
    write(tmp_path, "b.csv", '﻿"text","id",""\n"null","3",z\n')
    write(tmp_path, "c.csv", "")
    write(tmp_path, "d.csv", "id,id\n4,5\n")
    assert loaded(raw.read_csv(spark, str(tmp_path))) == [
        ("a.csv", 0, {"id": "1", "text": "one"}),
        ("a.csv", 1, {"id": "2"}),
        ("b.csv", 0, {"id": "3", "Unnamed: 2": "z"}),
        ("d.csv", 0, {"id": "4", "id.1": "5"}),
    ]
    assert [r.source_file for r in raw.csv_rejects(spark, str(tmp_path)).collect()] == ["c.csv"]


def test_csv_rows_that_do_not_fit_are_rejected_whole(spark, tmp_path):
    write(tmp_path, "a.csv", "id,text\n1,fits\n2,has a stray, comma\n3\n4,\"fits, too\"\n")
    write(tmp_path, "b.csv", 'id,te"xt\n' + "5,five\n" * 200)
    write(tmp_path, "c.csv", "\n\n\n")
    write(tmp_path, "d.csv", "\n\nid,text\n6,after blank lines\n")
    got = loaded(raw.read_csv(spark, str(tmp_path)))
    assert [rec for _, _, rec in got] == [
        {"id": "1", "text": "fits"}, {"id": "4", "text": "fits, too"}, {"id": "6", "text": "after blank lines"},
    ]
    rejects = sorted((r.source_file, r.reason) for r in raw.csv_rejects(spark, str(tmp_path)).collect())
    assert rejects == [
        ("a.csv", "row 1 (2) does not have 2 cells"), ("a.csv", "row 2 (3) does not have 2 cells"),
        ("b.csv", "no header row"), ("c.csv", "no header row"),
    ]


def csv_corpus(name, directory, **more):
    aliases = {"msg_id": ["id"], "timestamp": ["date"], "sender": ["from"], "recipient": ["to"], "body": ["text"]}
    return {name: {"enabled": True, "raw_dir": str(directory), "column_aliases": aliases, **more}}


@pytest.mark.parametrize("headers", [1, 2])
def test_csv_corpora_run(spark, tmp_path, headers):
    raw_dir = tmp_path / "raw"
    write(raw_dir, "a.csv", "\n".join([*CSV_LINES, "9006,too,few"]) + "\n")
    if headers == 2:
        write(raw_dir, "b.csv", "text,id\nwords under another header,77\n")
        write(raw_dir, "c.csv", "\n")
        write(raw_dir, "d.txt", "\n".join(TEXT_LINES) + "\n")
    specs = load_specs(csv_corpus("logs", raw_dir, scan_text=headers == 2))
    spec, read, unread = specs["logs"], {1: 5, 2: 9}[headers], {1: 1, 2: 2}[headers]
    records = raw.read_corpus_raw(spark, spec)
    assert records.count() == read and not records.isEmpty() and records.select("ordinal").count() == read
    assert raw.csv_rejects(spark, str(raw_dir)).count() == unread
    assert raw.read_exploration_raw(spark, str(raw_dir)).count() == {1: 5, 2: 6}[headers]
    dry = run_corpus(spark, spec, dry_run=True)
    result = run_enabled(spark, specs, str(tmp_path / "out"))["logs"]
    assert (result.records_raw, result.records_unread, result.error) == (read, unread, "")
    assert dry.records_written == result.records_written == read_corpora(spark, str(tmp_path / "out")).count() == read
    # Every data row of every file is a record or a reject; a file without a header is one reject.
    assert read + unread == {1: 6, 2: 11}[headers]


def test_exploration_scan_is_recursive_and_prefers_json(spark, tmp_path):
    write(tmp_path / "x", "a.json", [{"n": 1}])
    write(tmp_path / "y", "a.json", {"messages": [{"n": 2}]})
    write(tmp_path / "y", "b.json", {"data": [{"n": 3}]})
    write(tmp_path / "y", "c.csv", "n\n4\n")
    assert loaded(raw.read_exploration_raw(spark, str(tmp_path))) == [
        ("x/a.json", 0, {"n": 1}), ("y/a.json", 0, {"n": 2}),
    ]
    write(tmp_path / "only" / "z", "c.csv", "n\n4\n")
    assert loaded(raw.read_exploration_raw(spark, str(tmp_path / "only"))) == [("z/c.csv", 0, {"n": "4"})]
    with pytest.raises(FileNotFoundError):
        raw.read_exploration_raw(spark, str(tmp_path / "x" / "none"))


def test_flat_scan_ignores_subdirectories(spark, tmp_path):
    write(tmp_path, "a.json", [{"n": 1}])
    write(tmp_path / "k=1", "b.json", [{"n": 2}])
    assert loaded(raw.read_json(spark, str(tmp_path))) == [("a.json", 0, {"n": 1})]


def test_equal_names_in_two_folders_keep_separate_ids(spark, tmp_path):
    for folder in ("x", "y"):
        write(tmp_path / folder, "a.json", [{"text": f"message in folder {folder}"}])
    rows = canonical(spark, spec_at("conti", tmp_path, recursive=True))
    assert len(rows) == 2 and {row["source_file"] for row in rows} == {"a.json"}


# --- per-record rules ---------------------------------------------------------


def test_alias_order_and_fall_through_q1(spark):
    spec = get_spec("conti")
    frame = normalize(
        records(spark, [
            ("f", 0, {"body": "canonical", "text": "alias"}),
            ("f", 1, {"text": None, "message": "later alias"}),
            ("f", 2, {"ID": 7, "fromId": 12}),
        ]), spec)
    rows = frame.select("*", F.to_json("extras").alias("j")).orderBy("ordinal").collect()
    assert [r.body for r in rows] == ["canonical", "later alias", None]
    assert json.loads(rows[0].j) == {"text": "alias"}
    assert json.loads(rows[1].j) == {}
    assert (rows[2].msg_id, rows[2].sender) == ("7", "12")


def test_null_sender_stays_null_q2(spark):
    rows = normalize(records(spark, [("f", 0, {"from": None, "text": "hello"})]), get_spec("conti")).collect()
    assert rows[0].sender is None


def test_generated_ids_use_place_in_file_q3(spark):
    spec = get_spec("conti")
    frame = records(spark, [("f.json", 0, {"text": "ok"}), ("f.json", 1, {"id": "  ", "text": "a long text"})])
    row = canonical_messages(frame, spec).first()
    assert row.message_id == hashlib.md5(b"conti::f.json::1").hexdigest()[:16]


def test_records_without_id_are_not_lumped_q4(spark):
    frame = records(spark, [("f", i, {"text": f"message number {i}"}) for i in range(5)])
    assert canonical_messages(frame, get_spec("conti")).count() == 5


def test_mixed_timestamp_formats_q5(spark):
    values = ["2022-02-14 10:00:00", "2022-02-14T13:00:00+03:00", 1644832800, "1644832800000", "14.02.2022 10:00:00",
              "02/14/2022 10:00:00", "nonsense"]
    frame = normalize(records(spark, [("f", i, {"date": v}) for i, v in enumerate(values)]), get_spec("conti"))
    got = [r.timestamp for r in frame.orderBy("ordinal").collect()]
    assert got == [dt.datetime(2022, 2, 14, 10)] * 6 + [None]


def test_csv_ids_stay_text_q6(spark, tmp_path):
    write(tmp_path, "a.csv", "id,text\n101,first message\n,second message\n")
    rows = canonical(spark, spec_at("conti", tmp_path))
    assert "101" in {row["message_id"] for row in rows} and len(rows) == 2


def test_any_configured_corpus_runs_q8(spark, tmp_path):
    write(tmp_path / "f", "posts.csv", "post_id,post_date,author,thread_id,body\n1,2010-01-01,ann,t9,a forum post\n")
    spec = load_specs({"my_forum": {
        "raw_dir": str(tmp_path / "f"),
        "column_aliases": {"msg_id": ["post_id"], "timestamp": ["post_date"], "sender": ["author"], "recipient": ["thread_id"]},
    }})["my_forum"]
    row = canonical(spark, spec)[0]
    assert (row["dataset"], row["actor"], row["timestamp"]) == ("my_forum", "ann", dt.datetime(2010, 1, 1))
    assert canonical(spark, spec_at("hack_forums", tmp_path / "f"))[0]["metadata"] == '{"recipient":"t9"}'


def test_dedup_can_be_off_or_use_another_column_q9(spark):
    frame = records(spark, [("f", 0, {"id": "1", "text": "same text", "k": 1}), ("f", 1, {"id": "1", "text": "same text", "k": 2}),
                            ("f", 2, {"id": "2", "text": "same text"})])
    spec = get_spec("conti")
    assert canonical_messages(frame, spec, IngestSettings(dedup_column=None)).count() == 3
    assert canonical_messages(frame, spec, IngestSettings(dedup_column="body")).count() == 1
    assert canonical_messages(frame, spec, IngestSettings(dedup_column="k")).count() == 3


def test_output_named_fields_stay_in_metadata_q10(spark):
    frame = records(spark, [("f", 0, {"id": "1", "text": "long enough", "actor": "x", "metadata": {"a": 1}})])
    assert json.loads(canonical_messages(frame, get_spec("conti")).first().metadata) == {"actor": "x", "metadata": {"a": 1}}


def test_list_valued_extra_q11(spark):
    frame = records(spark, [("f", 0, {"id": "1", "text": "long enough", "tags": ["a", "b"], "none": None})])
    assert json.loads(canonical_messages(frame, get_spec("conti")).first().metadata) == {"tags": ["a", "b"]}


def test_epoch_unit_is_judged_per_file_q12(spark):
    rows = [("sec", 0, {"origin_server_ts": 1709244000, "content": "a"}), ("sec", 1, {"origin_server_ts": "x", "content": "a"}),
            ("ms", 0, {"origin_server_ts": 1709244000000, "content": "a"}), ("ms", 1, {"origin_server_ts": 1709244000000, "content": "b"}),
            ("ms", 2, {"origin_server_ts": 5000, "content": "c"}),
            ("half", 0, {"origin_server_ts": 1, "content": "a"}), ("half", 1, {"origin_server_ts": 30e9, "content": "a"}),
            ("text", 0, {"origin_server_ts": "2024-02-29 22:00:00", "content": "a"})]
    frame = normalize(records(spark, rows), get_spec("black_basta"))
    got = {(r.record_file, r.ordinal): r.timestamp for r in frame.collect()}
    at = dt.datetime(2024, 2, 29, 22)
    assert got["sec", 0] == at and got["sec", 1] is None
    assert got["ms", 0] == at and got["ms", 2] == dt.datetime(1970, 1, 1, 0, 0, 5)
    # The two middle values average to 15e9, which is above the threshold.
    assert got["half", 1] == dt.datetime(1970, 12, 14, 5, 20)
    assert got["text", 0] == at


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_a_large_file_meets_its_facts_in_stretches(spark, monkeypatch, threshold):
    monkeypatch.setattr("chatseam.operators.normalize.STRETCH", 7)
    # The unit follows from the whole file: its first stretches alone would say seconds.
    rows = [("big", i, {"type": "m.room.message", "origin_server_ts": 5 if i < 20 else 1709244000000, "content": "x"}) for i in range(60)]
    rows += [("other", i, {"origin_server_ts": 1709244000, "content": "y"}) for i in range(3)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = {(r.record_file, r.ordinal): r.timestamp for r in normalize(records(spark, rows), get_spec("black_basta")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    at = dt.datetime(2024, 2, 29, 22)
    assert len(got) == 63 and all(got["other", i] == at for i in range(3))
    assert all(got["big", i] == (dt.datetime(1970, 1, 1, 0, 0, 0, 5000) if i < 20 else at) for i in range(60))


def test_event_type_is_judged_per_file_q14(spark):
    rows = [("typed", 0, {"type": "m.room.message", "content": "kept"}), ("typed", 1, {"content": "dropped"}),
            ("typed", 2, {"type": "other", "content": "dropped"}), ("untyped", 0, {"content": "kept too"})]
    got = normalize(records(spark, rows), get_spec("black_basta")).orderBy("record_file").collect()
    assert [r.body for r in got] == ["kept", "kept too"]


def test_nested_body_kinds(spark):
    rows = [("f", 0, {"content": {"body": "nested"}}), ("f", 1, {"content": "plain"}), ("f", 2, {"content": [1], "body": "lost"}),
            ("f", 3, {"body": "no content field"}), ("f", 4, {"content": {"x": 1}})]
    got = normalize(records(spark, rows), get_spec("black_basta")).orderBy("ordinal").collect()
    assert [r.body for r in got] == ["nested", "plain", None, "no content field", None]


def test_language_preset_is_kept(spark):
    frame = records(spark, [("f", 0, {"id": "1", "text": "the cat and the dog", "language": "xx"}),
                            ("f", 1, {"id": "2", "text": "the cat and the dog", "language": "unknown"})])
    got = canonical_messages(frame, get_spec("conti")).orderBy("message_id").collect()
    assert [r.language for r in got] == ["xx", "en"]


def test_first_copy_wins_whatever_the_partitioning(spark):
    frame = records(spark, [(f"f{i % 3}", i, {"id": str(i % 7), "text": f"text number {i}"}) for i in range(60)])
    spec = get_spec("conti")
    one = canonical_messages(frame.repartition(1), spec).orderBy("message_id").collect()
    many = canonical_messages(frame.repartition(16), spec).orderBy("message_id").collect()
    assert one == many and len(one) == 7
    assert {r.source_file for r in one} == {"f0"}


def test_spec_lookup_errors():
    with pytest.raises(ValueError, match="available: .*conti"):
        get_spec("nobody")
    with pytest.raises(KeyError):
        get_spec("conti", {})
    assert {"babuk", "black_basta", "conti", "lockbit"} <= set(load_specs())


def test_transform_hook(spark):
    spec = replace(get_spec("conti"), transform=lambda frame: frame.where("sender = 'ann'"))
    frame = records(spark, [("f", 0, {"from": "ann", "text": "first text"}), ("f", 1, {"from": "bob", "text": "other text"})])
    assert canonical_messages(frame, spec).count() == 1


def test_alias_names_may_hold_quotes(spark):
    spec = CorpusSpec("odd", {"body": ("it's", "back\\slash")})
    rows = [("f", 0, {"it's": "quoted name"}), ("f", 1, {"back\\slash": "escaped name"})]
    got = normalize(records(spark, rows), spec).orderBy("ordinal").collect()
    assert [r.body for r in got] == ["quoted name", "escaped name"]
