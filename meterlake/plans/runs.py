"""Keyed tables that grow by runs: batches are appended, runs are merged now and then, readers see snapshots.

A table is a folder of runs and a log of numbered snapshots, each a small text that names the live runs. Nothing of a
run is changed once a snapshot names it. Eight runs of a level become one of the next, so a row is written again
once per level and the number of runs grows with the logarithm of the batches. A run is cut into buckets of its keys'
hashes, about so many rows each. One writer at a time, as for the stored events.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.schema import hadoop_path, path_exists
from meterlake.staging import broadcast_if_small

RUNS_PER_LEVEL = 8
ROWS_PER_BUCKET = 262_144

# Up to so many buckets are named in the scan's filter; a batch that touches more reads all.
NAMED_BUCKETS = 4_096

# More keys a bucket than that leave hardly any bucket out, so all are read and the keys' buckets are not worked out.
KEYS_PER_BUCKET = 16

# Older snapshots are removed; a reader opens the latest.
SNAPSHOTS_KEPT = 16


@dataclass(frozen=True)
class Run:
    name: str
    rows: int
    slots: int
    level: int


@dataclass(frozen=True)
class Snapshot:
    """``prepared`` is written but does not count yet; ``retired`` were merged and go at the next merge."""

    number: int = 0
    live: tuple[Run, ...] = ()
    prepared: Run | None = None
    retired: tuple[str, ...] = ()


def bucket_code(key: str, slots: int) -> Column:
    """The bucket of a key in a run of ``slots`` buckets, a power of two.

    Codes of different powers differ: those of ``slots`` lie from ``slots`` to ``2 * slots - 1``.
    """
    return F.lit(slots).cast("bigint") + F.pmod(F.xxhash64(key), F.lit(slots).cast("bigint"))


def slots_for(rows: int, per_bucket: int) -> int:
    """The least power of two that leaves at most ``per_bucket`` rows to a bucket on average."""
    return 1 << max(-(-rows // per_bucket) - 1, 0).bit_length()


def level_of(rows: int, per_bucket: int) -> int:
    """How often a 64th of a bucket must grow eightfold to have ``rows``."""
    level, reach = 0, max(per_bucket // 64, 1) * RUNS_PER_LEVEL
    while rows >= reach:
        level, reach = level + 1, reach * RUNS_PER_LEVEL
    return level


@dataclass(frozen=True)
class KeyedRuns:
    """A table under ``root`` with rows of ``schema``, looked up by ``key``, a text that is never null.

    ``merged`` makes one row per key of the rows of several runs; None where keys are never appended twice.
    """

    spark: SparkSession
    root: str
    schema: T.StructType
    key: str
    merged: Callable[[DataFrame], DataFrame] | None = None
    rows_per_bucket: int = ROWS_PER_BUCKET

    @property
    def _log(self) -> str:
        return f"{self.root}/_snapshots"

    def exists(self) -> bool:
        return path_exists(self.spark, self._log)

    def snapshot(self) -> Snapshot:
        """The latest snapshot; an empty one of number 0 when nothing was written yet."""
        if not self.exists():
            return Snapshot()
        fs, folder = hadoop_path(self.spark, self._log)
        numbers = [s.getPath().getName() for s in fs.listStatus(folder)]
        numbers = [n for n in numbers if n.isdigit()]
        if not numbers:
            return Snapshot()
        _, path = hadoop_path(self.spark, f"{self._log}/{max(numbers)}")
        stream = fs.open(path)
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        prepared = found["prepared"]
        return Snapshot(
            found["number"],
            tuple(Run(**r) for r in found["live"]),
            None if prepared is None else Run(**prepared),
            tuple(found["retired"]),
        )

    def _publish(self, new: Snapshot) -> Snapshot:
        """Make ``new`` the latest snapshot. It is written aside and renamed, so it is there whole or not at all."""
        name = f"{self._log}/{new.number:012d}"
        fs, path = hadoop_path(self.spark, name)
        _, aside = hadoop_path(self.spark, f"{self._log}/.{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        stream.write(bytearray(json.dumps(asdict(new)).encode()))
        stream.close()
        if fs.exists(path) or not fs.rename(aside, path):
            fs.delete(aside, False)
            raise RuntimeError(f"another writer made snapshot {new.number} of {self.root}")
        _, old = hadoop_path(self.spark, f"{self._log}/{new.number - SNAPSHOTS_KEPT:012d}")
        fs.delete(old, False)
        return new

    def _write(self, rows: DataFrame, count: int, least_level: int = 0) -> Run:
        level = max(least_level, level_of(count, self.rows_per_bucket))
        run = Run(uuid.uuid4().hex, count, slots_for(count, self.rows_per_bucket), level)
        (
            rows.select(*self.schema.fieldNames(), bucket_code(self.key, run.slots).alias("bucket"))
            .hint("rebalance", "bucket")
            .sortWithinPartitions("bucket", self.key)
            .write.partitionBy("bucket")
            .parquet(f"{self.root}/run={run.name}")
        )
        return run

    def _read(self, runs: Sequence[Run]) -> DataFrame:
        """Rows of ``runs`` with their bucket."""
        schema = T.StructType([*self.schema.fields, T.StructField("bucket", T.LongType())])
        if not runs:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/run={r.name}" for r in runs]
        return self.spark.read.schema(schema).option("basePath", self.root).parquet(*paths).select(*schema.fieldNames())

    def read(self) -> DataFrame:
        """All rows of the latest snapshot."""
        return self._one_per_key(self._read(self.snapshot().live).drop("bucket"))

    def _one_per_key(self, rows: DataFrame) -> DataFrame:
        return rows if self.merged is None else self.merged(rows).select(*self.schema.fieldNames())

    def stored(self, keys: DataFrame) -> DataFrame:
        """The values of ``key`` in ``keys`` (staged) that the table has. Only their buckets are read, unless those are nearly all."""
        runs = self.snapshot().live
        slots = sorted({r.slots for r in runs})
        if not slots:
            return keys.select(self.key).limit(0)
        if keys.count() > KEYS_PER_BUCKET * sum(slots):
            return self._read(runs).select(self.key).join(broadcast_if_small(keys.select(self.key)), self.key, "left_semi").distinct()
        codes = F.explode(F.array(*[bucket_code(self.key, s) for s in slots]))
        wanted = keys.select(self.key, codes.alias("bucket"))
        table = self._read(runs).select(self.key, "bucket")
        named = [r.bucket for r in wanted.select("bucket").distinct().limit(NAMED_BUCKETS + 1).collect()]
        if len(named) <= NAMED_BUCKETS:
            table = table.where(F.col("bucket").isin(named))
        found = table.join(broadcast_if_small(wanted), [self.key, "bucket"], "left_semi")
        return found.select(self.key).distinct()

    def prepare(self, rows: DataFrame, count: int) -> None:
        """Write ``count`` rows that ``commit`` makes count; until then ``prepared_rows`` has them."""
        now = self.snapshot()
        if now.prepared is not None:
            raise RuntimeError(f"{self.root} has rows that were prepared and neither committed nor replaced")
        run = self._write(rows, count)
        self._publish(Snapshot(now.number + 1, now.live, run, now.retired))

    def prepared_rows(self) -> DataFrame | None:
        run = self.snapshot().prepared
        return None if run is None else self._read([run]).drop("bucket")

    def commit(self) -> None:
        """Let the prepared rows count, then merge full levels."""
        now = self.snapshot()
        self._publish(Snapshot(now.number + 1, (*now.live, now.prepared), None, now.retired))
        self._merge()

    def replace_prepared(self, rows: DataFrame, count: int) -> None:
        """Let ``rows`` count instead of the prepared ones."""
        now = self.snapshot()
        live = (*now.live, self._write(rows, count)) if count else now.live
        self._publish(Snapshot(now.number + 1, live, None, (*now.retired, now.prepared.name)))

    def append(self, rows: DataFrame, count: int) -> None:
        """Add ``count`` rows, which count all at once or not at all."""
        if count:
            now = self.snapshot()
            run = self._write(rows, count)
            self._publish(Snapshot(now.number + 1, (*now.live, run), now.prepared, now.retired))
            self._merge()

    def _merge(self) -> None:
        """Make one run of each level that is full, from the lowest on.

        What an earlier merge replaced is removed now, so readers of the snapshot before go on undisturbed.
        """
        now = self.snapshot()
        level = 0
        while any(r.level >= level for r in now.live):
            full = [r for r in now.live if r.level == level]
            if len(full) >= RUNS_PER_LEVEL:
                rows = self._one_per_key(self._read(full).drop("bucket"))
                count = sum(r.rows for r in full) if self.merged is None else rows.count()
                run = self._write(rows, count, level + 1)
                live = (*[r for r in now.live if r.level != level], run)
                for name in now.retired:
                    fs, folder = hadoop_path(self.spark, f"{self.root}/run={name}")
                    fs.delete(folder, True)
                now = self._publish(Snapshot(now.number + 1, live, now.prepared, tuple(r.name for r in full)))
            level += 1
