"""Ingest: changed files to new events, rejects, manifest, alerts and a report."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions import labels
from meterlake.plans.alerts import fire_alerts
from meterlake.plans.store import UsageStore
from meterlake.sources import files as landed
from meterlake.sources.api_records import logged_calls, parse_api_records
from meterlake.sources.budgets import DEFAULT_FRACTIONS
from meterlake.sources.org_reports import parse_org_reports
from meterlake.sources.pricing import PriceTable
from meterlake.sources.records import accepted, priced, rejected
from meterlake.sources.session_logs import log_pattern, parse_session_lines
from meterlake.staging import StagingArea

LOG = logging.getLogger(__name__)

# The name of the alert step among the sources of a report; it is there only when the step failed.
ALERT_STEP = "alerts"


@dataclass(frozen=True)
class FileSource:
    """Files of one kind and the function that makes drafts of them.

    ``drafts`` gets a staging area, the changed files and their oldest
    modification time.
    """

    name: str
    pattern: str
    drafts: Callable[[StagingArea, DataFrame, dt.datetime], DataFrame]


def session_log_source(root: str, dedupe_on: str = "line") -> FileSource:
    pattern = log_pattern(root)

    def drafts(area, files, since):
        return parse_session_lines(landed.read_lines(area, pattern, files, since), dedupe_on)

    return FileSource(labels.SESSION_LOG, pattern, drafts)


def api_record_source(pattern: str) -> FileSource:
    def drafts(area, files, since):
        return parse_api_records(logged_calls(landed.read_lines(area, pattern, files, since)))

    return FileSource(labels.API, pattern, drafts)


def org_report_source(pattern: str) -> FileSource:
    """One report page per file."""

    def drafts(area, files, since):
        pages = landed.read_whole(area.spark, pattern, files, since)
        return parse_org_reports(pages.select(F.col("value").alias("payload"), F.col("file_path").alias("location")))

    return FileSource(labels.ORG_REPORT, pattern, drafts)


@dataclass(frozen=True)
class Ingested:
    """What one source gave: files that match and those of them unchanged, events added and found again, records rejected.

    Of a step that failed only the error is known, as it may have stored rows before: its numbers are None, not 0.
    """

    source: str
    files_scanned: int | None = 0
    files_unchanged: int | None = 0
    rows_added: int | None = 0
    duplicates: int | None = 0
    records_skipped: int | None = 0
    error: str | None = None


class IngestFailed(RuntimeError):
    """Steps of an ingest failed, the others are done; ``errors`` are the failed steps' names and what they raised."""

    def __init__(self, errors: Sequence[tuple[str, Exception]]) -> None:
        super().__init__("\n".join(f"{step} failed: {_error_text(error)}" for step, error in errors))
        self.errors = list(errors)


def _error_text(error: Exception) -> str:
    """Never empty, whatever was raised."""
    return f"{type(error).__name__}: {error}"


def ingest_files(store: UsageStore, source: FileSource, files: DataFrame, prices: PriceTable) -> tuple[int, int, int]:
    """Ingest the given (staged) files; returns rows added, duplicates and records skipped.

    The files go into the manifest last. If the job dies before that, the next
    run reads them again, and the keys keep their events from counting twice.
    """
    since = landed.oldest_change(files)
    if since is None:
        return 0, 0, 0
    with StagingArea(store.spark, f"ingest-{source.name}") as area:
        rows = area.stage(priced(source.drafts(area, files, since), prices), "parsed")
        skipped = store.append_rejects(rejected(rows))
        usable = accepted(rows)
        added, offered = store.append_events(usable), usable.count()
    store.record_files(files)
    return added, offered - added, skipped


def ingest_source(store: UsageStore, source: FileSource, prices: PriceTable) -> Ingested:
    """Ingest the files of a source that changed since they were last read."""
    spark = store.spark
    if not landed.matches_any(spark, source.pattern):
        return Ingested(source.name)
    with StagingArea(spark, f"files-{source.name}") as area:
        listed = area.stage(landed.list_files(spark, source.pattern), "listed")
        changed = area.stage(landed.changed_files(listed, store.manifest()), "changed")
        added, duplicates, skipped = ingest_files(store, source, changed, prices)
        scanned = listed.count()
        return Ingested(source.name, scanned, scanned - changed.count(), added, duplicates, skipped)


def ingest(
    store: UsageStore,
    sources: Sequence[FileSource],
    prices: PriceTable,
    budgets: DataFrame | None = None,
    now: dt.datetime | None = None,
    fractions: Sequence = DEFAULT_FRACTIONS,
    outbox: bool = False,
    count_stored: bool = True,
    strict: bool = False,
) -> DataFrame:
    """Ingest all sources, then fire budget alerts; returns the report.

    A source that fails does not stop the others; neither does the alert step. What failed has
    its error in the report and no numbers, the alert step as a source ``alerts``. With ``strict``
    it is raised as ``IngestFailed`` when all else is done, so that a store that lacks
    rows is not taken for a whole one.

    ``count_stored=False`` leaves out the number of stored events, which opens the footer of every stored file.
    """
    before = store.events().count() if count_stored else None
    results, errors = [], []
    for source in sources:
        try:
            results.append(ingest_source(store, source, prices))
        except Exception as error:
            LOG.exception("source %s failed", source.name)
            errors.append((source.name, error))
            results.append(_failed(source.name, error))
    if budgets is not None:
        try:
            fire_alerts(store, budgets, now or dt.datetime.now(dt.timezone.utc), fractions, outbox)
        except Exception as error:
            LOG.exception("alert step failed")
            errors.append((ALERT_STEP, error))
            results.append(_failed(ALERT_STEP, error))
    if strict and errors:
        raise IngestFailed(errors) from errors[0][1]
    return _report(store, results, before)


def _failed(step: str, error: Exception) -> Ingested:
    return Ingested(step, None, None, None, None, None, _error_text(error))


def _report(store: UsageStore, results: Sequence[Ingested], before: int | None) -> DataFrame:
    columns: Mapping[str, pa.DataType] = {
        "source": pa.string(),
        "files_scanned": pa.int64(),
        "files_unchanged": pa.int64(),
        "rows_added": pa.int64(),
        "duplicates": pa.int64(),
        "records_skipped": pa.int64(),
        "error": pa.string(),
    }
    table = pa.table(
        {name: [getattr(r, name) for r in results] for name in columns}, schema=pa.schema(list(columns.items()))
    )
    if before is None:
        after = None
    elif any(r.rows_added is None for r in results):
        after = store.events().count()
    else:
        after = before + sum(r.rows_added for r in results)
    return store.spark.createDataFrame(table).withColumns(
        {"events_before": F.lit(before).cast("bigint"), "events_after": F.lit(after).cast("bigint")}
    )
