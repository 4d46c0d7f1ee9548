"""Corpus specifications: the parameters that drive the generic normaliser."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

CANONICAL_FIELDS = ("msg_id", "timestamp", "sender", "recipient", "body")

DEFAULT_ENVELOPE_KEYS = ("messages", "data", "records", "items")
EVENT_ENVELOPE_KEYS = ("chunk", "events", "messages", "data")


@dataclass(frozen=True)
class CorpusSpec:
    """Where a corpus lives and how its records map to the canonical fields.

    ``event_type`` keeps records whose ``type`` equals it, judged per file that
    has such a key. ``nested_body`` names a field that, when a record carries
    it, alone decides the body. ``promote_body`` are fields copied into an
    absent body without being consumed. ``passthrough`` fields are repeated in
    the metadata under ``passthrough_prefix``. ``epoch_rule`` decides whether a
    numeric time is read as seconds or milliseconds: per row, or for a whole
    file by its median. ``load`` and ``transform`` are extension hooks.
    """

    name: str
    column_aliases: Mapping[str, tuple[str, ...]]
    enabled: bool = False
    display_name: str = ""
    description: str = ""
    raw_dir: str = ""
    formats: tuple[str, ...] = ("json", "csv")
    languages: tuple[str, ...] = ("en",)
    date_range: tuple[str, str] | None = None
    source: str = ""
    notes: str = ""
    envelope_keys: tuple[str, ...] = DEFAULT_ENVELOPE_KEYS
    scan_text: bool = False
    recursive: bool = False
    event_type: str | None = None
    msgtypes: tuple[str, ...] | None = None
    nested_body: str | None = None
    promote_body: tuple[str, ...] = ()
    passthrough: tuple[str, ...] = ()
    passthrough_prefix: str = ""
    epoch_rule: str = "row"
    load: Callable[[SparkSession, "CorpusSpec"], DataFrame] | None = field(default=None, compare=False)
    transform: Callable[[DataFrame], DataFrame] | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if self.epoch_rule not in ("row", "file_median"):
            raise ValueError(f"epoch_rule must be 'row' or 'file_median', not {self.epoch_rule!r}")
        if not self.display_name:
            object.__setattr__(self, "display_name", self.name)
        if not self.raw_dir:
            object.__setattr__(self, "raw_dir", f"data/raw/{self.name}")


@dataclass(frozen=True)
class IngestSettings:
    """Cleaning thresholds. ``dedup_column=None`` keeps every record."""

    min_body_length: int = 5
    dedup_column: str | None = "msg_id"


# Field names met in each corpus family, and the corpora's own facts.
BUILT_IN_SPECS: dict[str, CorpusSpec] = {
    spec.name: spec
    for spec in (
        CorpusSpec(
            name="conti",
            display_name="Conti chats, leaked 2022",
            formats=("json", "csv"),
            column_aliases={
                "msg_id": ("id", "message_id", "msg_id", "ID"),
                "timestamp": ("date", "ts", "timestamp", "time", "Date"),
                "sender": ("from", "fromId", "from_id", "sender", "From", "author"),
                "recipient": ("to", "toId", "to_id", "recipient", "To"),
                "body": ("text", "body", "message", "content", "msg", "Text", "Message"),
            },
            languages=("ru", "en"),
            date_range=("2020-01-01", "2022-02-27"),
        ),
        CorpusSpec(
            name="babuk",
            display_name="Babuk files, leaked 2021",
            formats=("json", "csv", "txt"),
            scan_text=True,
            column_aliases={
                "msg_id": ("id", "message_id"),
                "timestamp": ("date", "timestamp", "time"),
                "sender": ("from", "sender", "author"),
                "recipient": ("to", "recipient"),
                "body": ("text", "body", "message", "content"),
            },
            languages=("ru", "en"),
            date_range=("2020-06-01", "2021-07-01"),
        ),
        CorpusSpec(
            name="black_basta",
            display_name="Black Basta rooms",
            # The event export exists as JSON only.
            formats=("json",),
            column_aliases={
                "msg_id": ("event_id", "id", "message_id"),
                "timestamp": ("origin_server_ts", "timestamp", "date"),
                "sender": ("sender", "from", "user_id"),
                "recipient": ("room_id", "to", "recipient"),
                "body": ("body", "content", "message", "text"),
            },
            languages=("ru", "en"),
            date_range=("2022-09-01", "2024-09-18"),
            envelope_keys=EVENT_ENVELOPE_KEYS,
            event_type="m.room.message",
            nested_body="content",
            epoch_rule="file_median",
        ),
        CorpusSpec(
            name="lockbit",
            display_name="LockBit tickets and messages",
            formats=("json", "csv"),
            column_aliases={
                "msg_id": ("id", "message_id", "ticket_id"),
                "timestamp": ("created_at", "timestamp", "date"),
                "sender": ("sender", "from", "username", "user"),
                "recipient": ("to", "recipient", "room"),
                "body": ("body", "message", "text", "content", "description"),
            },
            languages=("en", "ru"),
            date_range=("2020-01-01", "2024-05-01"),
            promote_body=("message", "description"),
            passthrough=("record_type", "category", "status", "priority"),
            passthrough_prefix="lk_",
        ),
        CorpusSpec(
            name="hack_forums",
            display_name="Hack Forums posts",
            formats=("csv", "json"),
            column_aliases={
                "msg_id": ("post_id", "id"),
                "timestamp": ("post_date", "date", "timestamp"),
                "sender": ("author", "username", "user_id"),
                "recipient": ("thread_id", "forum_id"),
                "body": ("body", "post_body", "content", "text"),
            },
            languages=("en",),
            date_range=("2007-01-01", "2015-12-31"),
        ),
        CorpusSpec(
            name="custom",
            display_name="A corpus of your own",
            formats=("json", "csv", "txt"),
            scan_text=True,
            column_aliases={
                "msg_id": ("id",),
                "timestamp": ("timestamp",),
                "sender": ("sender",),
                "recipient": ("recipient",),
                "body": ("body",),
            },
        ),
    )
}


def load_specs(entries: Mapping[str, Mapping[str, Any]] | None = None) -> dict[str, CorpusSpec]:
    """Built-in specs, or the given ``{name: settings}`` entries laid over them.

    An entry for a built-in name changes only the settings it states; any other
    name makes a new corpus that runs on the generic normaliser.
    """
    if entries is None:
        return dict(BUILT_IN_SPECS)
    specs: dict[str, CorpusSpec] = {}
    for name, settings in entries.items():
        settings = dict(settings)
        if "column_aliases" in settings:
            settings["column_aliases"] = {k: tuple(v) for k, v in settings["column_aliases"].items()}
        if name in BUILT_IN_SPECS:
            specs[name] = replace(BUILT_IN_SPECS[name], **settings)
        else:
            settings.setdefault("column_aliases", {})
            specs[name] = CorpusSpec(name=name, **settings)
    return specs


def registered_names(specs: Mapping[str, CorpusSpec] | None = None) -> list[str]:
    return sorted({*BUILT_IN_SPECS, *(specs or {})})


def get_spec(name: str, specs: Mapping[str, CorpusSpec] | None = None) -> CorpusSpec:
    """Look a corpus up: ValueError if nobody knows it, KeyError if it is known but not configured."""
    configured = BUILT_IN_SPECS if specs is None else specs
    if name in configured:
        return configured[name]
    if name in BUILT_IN_SPECS:
        raise KeyError(f"corpus {name!r} is known but has no configuration entry")
    raise ValueError(f"unknown corpus {name!r}; available: {', '.join(registered_names(configured))}")


def enabled_specs(specs: Mapping[str, CorpusSpec]) -> list[CorpusSpec]:
    return [spec for spec in specs.values() if spec.enabled]


def raw_location(spec: CorpusSpec, root: str | None = None) -> str:
    """The corpus directory, below ``root`` if one is given and the spec's path is relative."""
    if root is None or "://" in spec.raw_dir or Path(spec.raw_dir).is_absolute():
        return spec.raw_dir
    return f"{root.rstrip('/')}/{spec.raw_dir}"
