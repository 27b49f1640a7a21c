"""Streams over usage events.

Delays are watermark texts such as ``1 hour``. A watermark drops what comes later than that after the
largest time of earlier batches, so it is for events that land about in order of time. A table whose files are in
no such order is aggregated with no delay (None), which loses nothing and keeps a state for each
key of the result, and deduplicated by ``append_stream``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterlake.operators.reports import total_tokens
from meterlake.plans.alerts import fire_alerts
from meterlake.plans.ingest import FileSource, ingest_files
from meterlake.plans.store import UsageStore
from meterlake.schema import is_folder, read_or_empty
from meterlake.sources.budgets import DEFAULT_FRACTIONS
from meterlake.sources.pricing import PriceTable
from meterlake.staging import StagingArea, new_staging_path

LANDED_FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """State of streams started from now on is kept by RocksDB instead of in the executors' heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_table_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A Parquet table, a folder or a single file, as a stream of its files, so many at a time.

    Files come by the time at which they were written, which tells nothing about the times of their rows.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    if is_folder(spark, path):
        return reader.parquet(path)
    # A stream watches a folder, so a single file is picked out by its name.
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def deduplicated(events: DataFrame, delay: str) -> DataFrame:
    """Each event once, if its repeats come within ``delay`` of each other.

    State is kept for ``delay`` only. Exact deduplication over all time is
    ``append_stream``, which looks the keys up in the store.
    """
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_uid"])


def _watermarked(events: DataFrame, delay: str | None) -> DataFrame:
    return events if delay is None else events.withWatermark("ts", delay)


def tumbling_spend(events: DataFrame, delay: str | None, width: str = "1 hour") -> DataFrame:
    """Calls, spend and tokens per window and model: of closed windows in append mode, of all with ``write_latest``.

    Without a delay no row is late and no window closes, so only ``write_latest`` gives them.
    """
    return (
        _watermarked(events, delay)
        .groupBy(F.window("ts", width).alias("window"), "model")
        .agg(
            F.count(F.lit(1)).alias("call_count"),
            F.sum("cost_usd").alias("spend_usd"),
            F.sum(total_tokens()).alias("tokens"),
        )
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                "model", "call_count", "spend_usd", "tokens")
    )


def call_bursts(
    events: DataFrame, delay: str | None, min_calls: int, width: str = "60 minutes", slide: str = "5 minutes"
) -> DataFrame:
    """Windows on a grid of ``slide`` in which a project makes many direct API calls.

    Windows on a grid can miss a burst that lies between two of them; the exact
    count per project is the batch operator ``densest_window``. The delay is as in
    ``tumbling_spend``.
    """
    calls = events.where((F.col("source") == "api") & ~F.col("is_batch"))
    return (
        _watermarked(calls, delay)
        .groupBy(F.window("ts", width, slide).alias("window"), F.coalesce("project", F.lit("")).alias("project"))
        .agg(F.count(F.lit(1)).alias("calls"))
        .where(F.col("calls") >= min_calls)
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                "project", "calls")
    )


def write_available(stream: DataFrame, label: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there now into a Parquet table, and return the table."""
    spark = stream.sparkSession
    path = path or new_staging_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint or f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def write_latest(stream: DataFrame, keys: Sequence[str], label: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream of aggregates over what is there now; returns the last state of each key.

    Batches write what they changed, so windows that the watermark has not passed
    at the end of the input are there too. A batch that is written again after a
    failure has the same number and the same rows.
    """
    spark = stream.sparkSession
    path = path or new_staging_path(spark, label)
    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(lambda rows, number: rows.withColumn("batch", F.lit(number)).write.mode("append").parquet(path))
        .option("checkpointLocation", checkpoint or f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    changes = read_or_empty(spark, path, stream.select("*", F.lit(0).cast("long").alias("batch")).schema)
    last = F.max_by(F.struct(*rest), F.col("batch")).alias("last")
    return changes.groupBy(*keys).agg(last).select(*[F.col(f"last.{c}").alias(c) if c in rest else F.col(c) for c in stream.columns])


def _each_batch(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame], None], continuous: str | None) -> StreamingQuery:
    trigger = {"processingTime": continuous} if continuous else {"availableNow": True}
    return (
        stream.writeStream.foreachBatch(lambda batch, _: handle(batch))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def append_stream(events: DataFrame, store: UsageStore, checkpoint: str, continuous: str | None = None) -> StreamingQuery:
    """Append a stream of priced events to the store, each key once.

    A batch that is repeated after a failure adds nothing, as its keys are there.
    ``continuous`` is the pause between batches; without it the stream ends when
    it has read what is there.
    """
    return _each_batch(events, checkpoint, lambda batch: store.append_events(batch), continuous)


def ingest_stream(
    store: UsageStore,
    source: FileSource,
    prices: PriceTable,
    checkpoint: str,
    budgets: DataFrame | None = None,
    clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc),
    fractions: Sequence = DEFAULT_FRACTIONS,
    continuous: str | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Ingest files as they land, and fire budget alerts after each batch.

    ``files_per_batch`` cuts a large backlog into batches of bounded size.

    The stream carries only the files' names, sizes and times; their contents are
    read by the batch code. A streaming source does not look at a file again, so
    files must be complete when they land. Logs that grow in place need the batch
    job ``ingest``.
    """
    reader = store.spark.readStream.format("binaryFile").schema(LANDED_FILE_SCHEMA)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    landed = (
        reader.load(source.pattern)
        .select(F.col("_metadata.file_path").alias("file_path"), "length", F.col("modificationTime").alias("modified"))
    )

    def handle(batch: DataFrame) -> None:
        with StagingArea(store.spark, "landed-files") as area:
            ingest_files(store, source, area.stage(batch, "files"), prices)
        if budgets is not None:
            fire_alerts(store, budgets, clock(), fractions)

    return _each_batch(landed, checkpoint, handle, continuous)
