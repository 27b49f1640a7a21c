"""The stored tables and how rows get into them exactly once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.operators.dedup import first_per_key, on_days_of, stored_keys
from meterlake.plans.runs import KeyedRuns
from meterlake.schema import (
    ALERT_SCHEMA,
    KEY_SCHEMA,
    MANIFEST_SCHEMA,
    REJECT_SCHEMA,
    USAGE_COLUMNS,
    USAGE_SCHEMA,
    path_exists,
    read_or_empty,
)
from meterlake.sources.files import latest_entries
from meterlake.staging import StagingArea, broadcast_if_small


@dataclass(frozen=True)
class UsageStore:
    """Parquet tables under one root folder."""

    spark: SparkSession
    root: str

    @property
    def events_path(self) -> str:
        return f"{self.root}/usage_events"

    @property
    def event_keys(self) -> KeyedRuns:
        """Key and day of every stored event."""
        return KeyedRuns(self.spark, f"{self.root}/event_keys", KEY_SCHEMA, "event_uid")

    @property
    def reject_runs(self) -> KeyedRuns:
        return KeyedRuns(self.spark, f"{self.root}/rejects", REJECT_SCHEMA, "reject_uid")

    @property
    def manifest_runs(self) -> KeyedRuns:
        return KeyedRuns(self.spark, f"{self.root}/file_manifest", MANIFEST_SCHEMA, "file_path", latest_entries)

    @property
    def alerts_path(self) -> str:
        return f"{self.root}/alerts"

    @property
    def outbox_path(self) -> str:
        return f"{self.root}/alert_outbox"

    def exists(self) -> bool:
        return path_exists(self.spark, self.events_path)

    def events(self) -> DataFrame:
        return read_or_empty(self.spark, self.events_path, USAGE_SCHEMA)

    def rejects(self) -> DataFrame:
        return self.reject_runs.read()

    def manifest(self) -> DataFrame:
        """The latest entry of each ingested file."""
        return self.manifest_runs.read()

    def alerts(self) -> DataFrame:
        return read_or_empty(self.spark, self.alerts_path, ALERT_SCHEMA)

    def append_events(self, events: DataFrame) -> int:
        """Add the events whose key is not stored; returns how many were added.

        Of several new events with one key the earliest counts. Events that are
        ``dated`` are looked up on their own day only, all others in their buckets
        of the key table.

        The keys are prepared before the events are written and count afterwards. If the
        job dies in between, the next one keeps those of them whose event is there.
        """
        if "dated" not in events.columns:
            events = events.withColumn("dated", F.lit(False))
        with StagingArea(self.spark, "append-events") as area:
            self._settle_keys(area)
            unique = area.stage(
                first_per_key(events, "event_uid", ["ts", "source", "session_id"]), "unique-events"
            )
            dated, undated = unique.where("dated"), unique.where("NOT dated")
            found = []
            if not dated.isEmpty():
                near = on_days_of(self.events().select("event_uid", "event_date"), dated, "event_date")
                found.append(stored_keys(dated, near, "event_uid"))
            if not undated.isEmpty():
                found.append(self.event_keys.stored(undated))
            # The keys that were found are staged rather than the new events, which are many
            # times as large; from then on, what is appended does not change which events are new.
            new, added = unique.select(*USAGE_COLUMNS), unique.count()
            for keys in found:
                known = area.stage(keys, "known-keys")
                count = known.count()
                if count:
                    new, added = new.join(broadcast_if_small(known), "event_uid", "left_anti"), added - count
            if added:
                self.event_keys.prepare(new, added)
                # Rebalancing splits a day that is too large for one task and joins
                # small ones, so that files come out even; sorting makes row groups
                # skippable by project, model and time.
                (
                    new.hint("rebalance", "event_date")
                    .sortWithinPartitions("event_date", "project", "model", "ts")
                    .write.mode("append")
                    .partitionBy("event_date")
                    .parquet(self.events_path)
                )
                self.event_keys.commit()
            return added

    def _settle_keys(self, area: StagingArea) -> None:
        """Make the key table that of the stored events, after a job that died or for a store that has none yet."""
        keys, names = self.event_keys, KEY_SCHEMA.fieldNames()
        if not keys.exists():
            stored = area.stage(self.events().select(*names), "keys-of-events")
            keys.append(stored, stored.count())
            return
        prepared = keys.prepared_rows()
        if prepared is not None:
            near = on_days_of(self.events().select(*names), prepared, "event_date")
            found = area.stage(prepared.join(stored_keys(prepared, near, "event_uid"), "event_uid", "left_semi"), "keys-found")
            keys.replace_prepared(found, found.count())

    def append_rejects(self, rejects: DataFrame) -> int:
        """Add rejected records not recorded before; returns how many were added."""
        with StagingArea(self.spark, "append-rejects") as area:
            unique = area.stage(first_per_key(rejects, "reject_uid", ["source", "location"]), "unique-rejects")
            known = self.reject_runs.stored(unique)
            new = area.stage(unique.join(known, "reject_uid", "left_anti"), "new-rejects")
            added = new.count()
            self.reject_runs.append(new, added)
            return added

    def record_files(self, files: DataFrame) -> None:
        """Note the (staged) files as ingested."""
        entries = files.select("file_path", "length", "modified", F.current_timestamp().alias("ingested"))
        self.manifest_runs.append(entries, files.count())
