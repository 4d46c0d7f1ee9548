"""Ingestion runs: raw directory to canonical table, with a summary."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from chatseam.operators.clean import clean, fill_language, to_canonical
from chatseam.operators.normalize import flag_events, normalize
from chatseam.operators.summary import run_summary
from chatseam.schema import with_validation
from chatseam.session import prepare
from chatseam.sources.listing import list_files
from chatseam.sources.parquet import corpus_path, read_status, write_corpus
from chatseam.sources.raw import corpus_rejects, read_corpus_raw
from chatseam.specs import CorpusSpec, IngestSettings, enabled_specs, raw_location

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class RunResult:
    corpus: str
    records_raw: int = 0
    records_after_normalize: int = 0
    records_after_clean: int = 0
    records_written: int = 0
    drop_rate: float = 0.0
    language_distribution: dict[str, int] = field(default_factory=dict)
    output_path: str = ""
    # Files, items and rows that no record could be read from, see ``corpus_rejects``.
    records_unread: int = 0
    # Why the run failed; empty if it did not.
    error: str = ""

    @property
    def records_rejected(self) -> int:
        return self.records_after_clean - self.records_written


def canonical_messages(
    records: DataFrame,
    spec: CorpusSpec,
    settings: IngestSettings = IngestSettings(),
) -> DataFrame:
    """Raw records to canonical rows plus ``errors``: normalise, clean, label, validate. Lazy."""
    return (
        normalize(records, spec)
        .transform(clean, spec, settings)
        .transform(fill_language)
        .transform(to_canonical, spec.name)
        .transform(with_validation)
    )


def _count_files(spark: SparkSession, spec: CorpusSpec, root: str | None) -> int:
    directory = raw_location(spec, root)
    suffixes = [f".{kind}" for kind in ("json", "csv") if kind in spec.formats]
    suffixes += [".txt"] if spec.scan_text else []
    return sum(len(list_files(spark, directory, suffix, spec.recursive)) for suffix in suffixes)


def run_corpus(
    spark: SparkSession,
    spec: CorpusSpec,
    output_dir: str | None = None,
    root: str | None = None,
    settings: IngestSettings = IngestSettings(),
    dry_run: bool = False,
) -> RunResult:
    """Ingest one corpus. A dry run computes every stage and writes nothing.

    No input gives a result of zeros. After a real run the later counts come
    from the table just written, so cleaning and deduplication run once, and
    they stay right when executors were lost on the way.
    """
    prepare(spark)
    if not spec.load and _count_files(spark, spec, root) == 0:
        log.warning("no input files for corpus %s in %s", spec.name, raw_location(spec, root))
        return RunResult(spec.name)
    records = read_corpus_raw(spark, spec, root)
    unread = corpus_rejects(spark, spec, root).count()
    if records.isEmpty():
        log.warning("no records for corpus %s", spec.name)
        return RunResult(spec.name, records_unread=unread)

    checked = canonical_messages(records, spec, settings)
    path = ""
    if not dry_run:
        if output_dir is None:
            raise ValueError("output_dir is needed unless dry_run is set")
        path = write_corpus(checked, output_dir, spec.name)
        checked = read_status(spark, corpus_path(output_dir, spec.name))
    counts = run_summary(spec.name, flag_events(records, spec), checked).first()
    return RunResult(
        corpus=spec.name,
        records_raw=counts["records_raw"],
        records_after_normalize=counts["records_after_normalize"],
        records_after_clean=counts["records_after_clean"],
        records_written=counts["records_written"],
        drop_rate=counts["drop_rate"],
        language_distribution=dict(counts["language_distribution"] or {}),
        output_path=path,
        records_unread=unread,
    )


def run_enabled(
    spark: SparkSession,
    specs: Mapping[str, CorpusSpec],
    output_dir: str | None = None,
    root: str | None = None,
    settings: IngestSettings = IngestSettings(),
    dry_run: bool = False,
) -> dict[str, RunResult]:
    """Run every enabled corpus; one that fails is logged, and its result is zeros and the error."""
    enabled = enabled_specs(specs)
    if not enabled:
        log.warning("no corpus is enabled")
    results = {}
    for spec in enabled:
        try:
            results[spec.name] = run_corpus(spark, spec, output_dir, root, settings, dry_run)
        except Exception as error:
            log.exception("corpus %s failed", spec.name)
            results[spec.name] = RunResult(spec.name, error=f"{type(error).__name__}: {error}")
    return results
