"""Does the n-th batch cost what the first did? python tests/batches.py new-folder [batches] [history]

A store is given a history of undated events, then batches of 2,000 new and 2,000 repeated events. For each
batch the script prints seconds, files of the key table, its runs and the rows that the batch read.
"""

from __future__ import annotations

import pathlib
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from meterlake import UsageStore  # noqa: E402
from meterlake.schema import USAGE_SCHEMA  # noqa: E402
from scale import stages  # noqa: E402

BATCH = 2_000


def events(spark: SparkSession, start: int, stop: int) -> DataFrame:
    """Events with the numbers from ``start`` to ``stop``, on 90 days."""
    second = F.col("id") * 7919 % (90 * 86_400)
    ts = F.timestamp_seconds(F.lit(1_780_000_000) + second)
    values = {
        "event_uid": F.sha2(F.col("id").cast("string"), 256),
        "ts": ts,
        "source": F.lit("api"),
        "model": F.lit("small"),
        "is_batch": F.lit(False),
        "cost_usd": F.lit("0.01"),
        "event_date": F.to_date(ts),
    }
    zero = {f.name: F.lit(0) for f in USAGE_SCHEMA.fields if f.name.endswith("_tokens")}
    values = {**values, **zero}
    return spark.range(start, stop).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in USAGE_SCHEMA.fields])


def main() -> None:
    folder = sys.argv[1]
    batches, history = (int(sys.argv[i]) if len(sys.argv) > i else default for i, default in ((2, 40), (3, 0)))
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", f"{folder}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    store = UsageStore(spark, f"{folder}/store")
    start = time.perf_counter()
    if history:
        store.append_events(events(spark, 0, history))
    print(f"history of {history} events: {time.perf_counter() - start:.1f} s", flush=True)
    for n in range(batches):
        known = set(stages(spark))
        first = history + n * BATCH
        start = time.perf_counter()
        added = store.append_events(events(spark, max(first - BATCH, 0), first + BATCH))
        took = time.perf_counter() - start
        read = sum(s.inputRecords() for number, s in stages(spark).items() if number not in known)
        files = len(list(pathlib.Path(store.event_keys.root).rglob("*.parquet")))
        runs = len(store.event_keys.snapshot().live)
        print(f"batch {n + 1:4d}  {took:6.2f} s  added {added}  read {read:8d} rows  key files {files:4d}  runs {runs:3d}", flush=True)


if __name__ == "__main__":
    main()
